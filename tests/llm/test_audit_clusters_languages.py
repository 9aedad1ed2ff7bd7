"""The filter audit, centroid clustering and language identification against plain versions and in their edge cases."""
import hashlib
import re
from itertools import permutations

import numpy as np
import pytest

from duskwire.llm import bytegru, centroids, filteraudit

# --- filter audit -----------------------------------------------------------------
AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller,
        }
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in bad))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        found = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                redundant = sum(f in r[0] and bool(r[0] & set(order[:k])) for r in mine)
                found[order, k + 1] = (len(left), len(gone), redundant, sum(r[0] == {f} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone))
        for (order, k), values in found.items():
            shapley = sum(v[1] for (o, j), v in found.items() if o[j - 1] == order[k - 1])
            out.add((part, order, k, *values, shapley))
    return out


def audit_rows(df):
    return {tuple(r[c] for c in AUDIT) for r in df.select(AUDIT).collect()}


def long_text(seed, n, words=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{r.integers(words)}" for _ in range(n))


DOCS = [
    (9, long_text(1, 300), "a"), (4, long_text(1, 300), "b"), (7, long_text(1, 300), "a"), (2, long_text(2, 300, 20), "a"), (3, "", None),
    (5, None, "a"), (6, "   \n\t", "c"), (8, "SHOUT " * 250, "b"), (1, "SHOUT " * 250, "b"), (10, long_text(3, 250) + " 5 % | x", "a"),
    (10, long_text(3, 250) + " 5 % | x", "a"), (11, "\x1cé ñ x" * 300, "b"), (None, "", "a"), (None, long_text(1, 300), "b"),
    (12, long_text(4, 40_000), "c"), (4, long_text(1, 300), "b"), (13, "SHOUT " * 250, "b"), (14, "short", ""),
]
LABELS = [(9, 1, 0), (4, 1, 1), (8, 0, 1), (8, None, None), (1, 1, None), (10, 1, 1), (10, 0, 0), (None, 1, 1), (99, 1, 1)]
DOC_COLUMNS = "doc_id long, text string, source string"
LABEL_COLUMNS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("backwards", [False, True])
def test_audit_over_many_batches(spark, tmp_path, backwards):
    """A file a batch; in descending order of ids each copy that arrives takes earlier counts back."""
    path = str(tmp_path / "documents.parquet")
    order = sorted(DOCS, key=lambda r: (r[0] is None, r[0] or 0), reverse=backwards)
    for k in range(0, len(order), 3):
        part = spark.createDataFrame(order[k : k + 3], DOC_COLUMNS).selectExpr("*", "1 as mask", "'x' as part", "2 as n")
        part.coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame(LABELS, LABEL_COLUMNS)
    assert audit_rows(filteraudit.filter_audit(spark, path, labels, bytes_per_core=1)) == plain_audit(DOCS, LABELS)


def test_audit_of_one_batch_and_one_file(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(DOCS, DOC_COLUMNS).toPandas().to_parquet(path)
    labels = spark.createDataFrame([], LABEL_COLUMNS)
    assert audit_rows(filteraudit.filter_audit(spark, path, labels)) == plain_audit(DOCS, [])


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOC_COLUMNS).write.parquet(path)
    assert not audit_rows(filteraudit.filter_audit(spark, path, spark.createDataFrame([], LABEL_COLUMNS)))


def test_state_retracts_an_earlier_count():
    one = ("a", 2, 1, 0)
    state, changes = filteraudit.merged(None, [(9, *one, 2)])
    assert state == (9, {one: 2}) and changes == {one: 2}
    state, changes = filteraudit.merged(state, [(4, "b", 2, 0, 0, 1), (5, "b", 2, 0, 0, 1)])
    assert state[0] == 4
    assert changes == {one: -2, ("a", 2 | 16, 1, 0): 2, ("b", 2, 0, 0): 1, ("b", 2 | 16, 0, 0): 1}


# --- centroid clustering ----------------------------------------------------------
def plain_clusters(vectors, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors
            if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in kept[:k]]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        home = [min(range(len(centres)), key=lambda j: (d[j], j)) for d in far]
        if turn == rounds:
            break
        for j in range(len(centres)):
            mine = [v for (_, v), h in zip(kept, home) if h == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [d[h] for d, h in zip(far, home)]
    each = {j: sum(d for d, h in zip(own, home) if h == j) for j in set(home)}
    digest = {j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest() for j in set(home)}
    return sorted((i, h, d, each[h], sum(own), digest[h]) for (i, _), h, d in zip(kept, home, own))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    middles = r.normal(0, 0.6, (9, 64))
    out = [(i, (middles[i % 9] + r.normal(0, 0.15, 64)).astype(np.float32).tolist()) for i in range(400)]
    out += [(500 + i, list(out[3][1])) for i in range(40)]  # equal vectors
    out += [(3, list(out[3][1])), (3, list(out[5][1]))]  # repeated ids
    bad = list(out[0][1])
    out += [(600, bad[:63]), (601, bad + [0.0]), (602, None), (603, [None] + bad[1:]), (604, [float("nan")] + bad[1:]),
            (605, [float("inf")] + bad[1:]), (None, bad), (606, [])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, point string")


def cluster_rows(df):
    return sorted(tuple(r) for r in df.drop("scans").collect())


def test_clusters_equal_plain_ones(spark, vectors):
    out = centroids.clustered(frame(spark, vectors).repartition(3))
    assert cluster_rows(out) == plain_clusters(vectors)
    scans = [r["scans"] for r in out.select("scans").collect()]
    assert min(scans) == 1 and sum(scans) < 0.8 * 4 * len(scans), "bounds must save work"


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, vectors, n):
    assert cluster_rows(centroids.clustered(frame(spark, vectors[:n]))) == plain_clusters(vectors[:n])


def test_very_large_components_are_held(spark):
    rows = [(i, [float(x)] * 64) for i, x in enumerate([3e38, -3e38, 0, 1])]
    got = cluster_rows(centroids.clustered(frame(spark, rows), k=2))
    assert len(got) == 4 and all(r[2] is not None and r[2] >= 0 for r in got)


def test_squared_distances_are_exact_for_large_components():
    r = np.random.default_rng(4)
    p, c = r.integers(-(1 << 26), 1 << 26, (5, 64)), r.integers(-(1 << 26), 1 << 26, (3, 64))
    assert centroids.squared(p, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in p]


def test_tightened_drift_bounds_and_is_less_than_full():
    r = np.random.default_rng(5)
    less = 0
    for _ in range(300):
        d = int(r.integers(2, 6))
        centre, old, new = r.normal(0, 3, d), r.normal(0, 3, d), r.normal(0, 3, d)
        radius = abs(r.normal(0, 1.5))
        x = r.normal(0, 1, (3000, d))
        x = centre + x / np.linalg.norm(x, axis=1)[:, None] * radius * r.random((3000, 1)) ** (1 / d)
        gain = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        bound, full = centroids.tightened(centre, radius, old, new), np.linalg.norm(old - new)
        assert gain <= bound + 1e-9 <= full + 2e-9
        less += bound < 0.9 * full
    assert less > 100
    assert centroids.tightened(np.zeros(2), 1.0, np.ones(2), np.ones(2)) == 0.0


# --- language identification ------------------------------------------------------
TONGUES = {"en": "the and of tion ing wh th er re", "de": "der und sch ung keit ü ß ei ch", "fr": "le de eau è é ou aux que ment"}


def tongue(lang, seed, n):
    r = np.random.default_rng(seed)
    parts = TONGUES[lang].split()
    return " ".join("".join(parts[r.integers(len(parts))] for _ in range(r.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages_found(spark):
    rows = [(i, tongue(lang, i, 5 + i % 60), lang, "s", 1) for i, lang in ((i, list(TONGUES)[i % 3]) for i in range(360))]
    rows += [(1000, None, "en", "s", 1), (1001, "", "de", "s", 1), (1002, " 12 -- \n", "fr", "s", 1), (1003, tongue("de", 7, 60_000), None, "s", 1),
             (None, tongue("fr", 8, 50), "fr", "s", 1), (5, rows[5][1], rows[5][2], "s", 1), (1004, tongue("en", 9, 90).upper(), None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, _lettered int").repartition(3)
    return docs, bytegru.languages(docs, bytegru.fit(docs, sample_docs=60)).collect(), rows


def test_held_out_accuracy(spark, languages_found):
    docs, found, rows = languages_found
    held = {r["doc_id"] for r in docs.filter(bytegru.held_out()).select("doc_id").collect()}
    mine = [r for r in found if r["doc_id"] in held and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(mine) > 50 and sum(r["lang_pred"] == r["lang"] for r in mine) >= 0.97 * len(mine)


def test_language_edge_cases(languages_found):
    _, found, rows = languages_found
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "lang", "_lettered", "lang_pred", "score"}
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by_id[1000] == by_id[1001] == by_id[1002] == [("und", 0.0)]
    assert by_id[1003][0][0] == "de" and by_id[1004][0][0] == "en" and by_id[None][0][0] == "fr"
    assert len(by_id[5]) == 2 and by_id[5][0] == by_id[5][1]
    assert all(0.0 <= r["score"] <= 1.0 for r in found)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {tuple(r) for r in bytegru.languages(docs, bytegru.fit(docs), ["doc_id"]).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    none = docs.limit(0)
    assert bytegru.languages(none, bytegru.fit(none)).collect() == []


def test_gradients_equal_differences():
    r = np.random.default_rng(6)
    w = {k: x.astype(np.float64) for k, x in bytegru.initial(3, width=4).items()}
    windows = r.integers(0, 5, (4, 6)).astype(np.uint8)
    inside = np.arange(6) < np.array([6, 3, 1, 6])[:, None]
    label = np.array([0, 2, 1, 1])
    _, grad = bytegru.loss_and_gradients(w, windows, inside, label)
    for name in w:
        for _ in range(4):
            at = tuple(int(r.integers(0, min(n, 5))) for n in w[name].shape)
            was = w[name][at]
            sides = []
            for step in (1e-6, -1e-6):
                w[name][at] = was + step
                sides.append(bytegru.loss_and_gradients(w, windows, inside, label)[0])
            w[name][at] = was
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[name][at]) < 1e-7, name


def test_document_probability_equals_a_plain_loop():
    """One byte at a time, one window at a time."""
    w = {k: x.astype(np.float64) for k, x in bytegru.initial(3).items()}
    squash = lambda x: x / (1 + abs(x))
    text = ("Straße " * 40).encode()[:150]

    def states(part, d):
        h, out = np.zeros(bytegru.WIDTH), []
        for byte in part if d == "f" else reversed(part):
            pre = {g: h @ w[f"rec_{d}{g}"] for g in "zrc"}
            z, r = (0.5 + 0.5 * squash(w[f"in_{d}{g}"][byte] + pre[g]) for g in "zr")
            c = squash(w[f"in_{d}c"][byte] + r * pre["c"])
            h = c + z * (h - c)
            out.append(h)
        return out if d == "f" else out[::-1]

    total = np.zeros(3)
    for lo in range(0, len(text), bytegru.STEPS):
        part = text[lo : lo + bytegru.STEPS].lower()
        for a, b in zip(states(part, "f"), states(part, "b"), strict=True):
            x = np.exp(a @ w["out_f"] + b @ w["out_b"] + w["out_bias"])
            total += x / x.sum()
    got = bytegru.document_probabilities(w, [b"", text])
    assert np.allclose(got[1], total / len(text), atol=1e-6) and not got[0].any()
