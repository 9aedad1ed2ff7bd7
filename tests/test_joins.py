"""Similarity joins against all pairs, with copies, ties, empty inputs and hot values."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwire.operators import cosine_join, nearest


def sparse(spark, rows):
    return spark.createDataFrame([(i, t, float(w)) for i, v in rows for t, w in v.items()], "id long, term int, weight double")


def unit(weights):
    size = np.sqrt(sum(w * w for w in weights.values()))
    return {t: w / size for t, w in weights.items()}


def random_sparse(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        centre = r.integers(6) * 30
        terms = np.unique(np.concatenate([r.integers(centre, centre + 40, 12), r.integers(0, 400, 4)]))
        out.append((i * 3 + 1, unit({int(t): float(r.random() + 0.1) for t in terms})))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("block_rows", [7, 1000])
def test_similar_pairs_equal_all_pairs(spark, threshold, block_rows):
    rows = random_sparse(1, 90)
    rows += [(900, rows[4][1]), (901, rows[4][1]), (902, {7: 1.0}), (903, {7: 1.0})]
    want = {}
    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            s = sum(w * b.get(t, 0.0) for t, w in a.items())
            if s >= threshold:
                want[i, j] = round(s, 9)
    got = cosine_join.similar_pairs(sparse(spark, rows), threshold, block_rows).collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == want and len(got) == len(want)


def test_prefixes_leave_vectors_apart(spark):
    """Two groups that share frequent terms alone never meet: their rare terms make the prefixes."""
    rows = [(i, unit({1: 0.2, 2: 0.2, 100 + i % 2: 1.0, 200 + i % 2: 1.0})) for i in range(40)]
    blocks = cosine_join.prefixed(sparse(spark, rows), 0.9, block_rows=20)
    assert blocks.groupBy("block").count().count() == 2
    assert cosine_join.visits(blocks).filter("block <> other").count() == 0
    assert cosine_join.similar_pairs(sparse(spark, rows), 0.9, 20).count() == 2 * 190


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """However many vectors there are up to the largest block, each is sent to no more than ``BLOCKS`` blocks."""
    r = np.random.default_rng(3)
    rows = [(i, {int(t): float(w) for t, w in zip(r.choice(12, 6, replace=False), r.random(6) + 0.1)}) for i in range(100)]
    rows = [(i, {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()}) for i, v in rows]
    monkeypatch.setattr(cosine_join, "LEAST_ROWS", 5)
    blocks = cosine_join.prefixed(sparse(spark, rows), 0.6)
    assert {x["count"] for x in blocks.groupBy("block").count().collect()} == {13, 9} and cosine_join.visits(blocks).count() <= 100 * cosine_join.BLOCKS
    whole = {tuple(x) for x in cosine_join.similar_pairs(sparse(spark, rows), 0.6, 1000).select("a", "b").collect()}
    assert {tuple(x) for x in cosine_join.similar_pairs(sparse(spark, rows), 0.6).select("a", "b").collect()} == whole != set()
    monkeypatch.setattr(cosine_join, "MOST_ROWS", 10)
    assert cosine_join.prefixed(sparse(spark, rows), 0.6).groupBy("block").count().count() == 10


def test_similar_pairs_of_nothing(spark):
    assert cosine_join.similar_pairs(sparse(spark, []), 0.5).collect() == []
    assert cosine_join.similar_pairs(sparse(spark, [(1, {3: 1.0})]), 0.5).collect() == []


def plain_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.any(np.array(v, float))]
    out = set()
    for i, a in ok:
        near = []
        for j, b in ok:
            if i != j:
                near.append((-round(float((a / np.sqrt(a @ a)) @ (b / np.sqrt(b @ b))), 9), j))
        for rank, (s, j) in enumerate(sorted(near)[:k], 1):
            out.add((i, rank, j, round(-s, 6) + 0.0))
    return out


@pytest.mark.parametrize("cell_rows", [9, 40, 1000])
def test_nearest_equals_all_pairs(spark, cell_rows):
    r = np.random.default_rng(2)
    middles = r.normal(0, 1, (5, 6))
    rows = [(i, (middles[i % 5] + r.normal(0, 0.2, 6)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(50)]  # a third of all rows
    rows += [(300, (2 * np.array(rows[7][1])).tolist()), (301, [0.0] * 6), (302, None), (303, [1.0, None, 0, 0, 0, 0]), (None, rows[7][1])]
    given = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>")
    got = nearest.nearest(given, 5, cell_rows).collect()
    assert {(x["id"], x["rank"], x["neighbour"], round(x["similarity"], 6) + 0.0) for x in got} == plain_nearest(rows, 5)
    assert len(got) == len(plain_nearest(rows, 5))


def test_vectors_are_sent_once_for_each_part(spark, monkeypatch):
    """Vectors that visit every cell are not sent more often than there are parts, however many rows there are."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(0, 1, 24).tolist()) for i in range(600)]
    sent, compared = [], nearest._compared
    monkeypatch.setattr(nearest, "LEAST_ROWS", 20)
    monkeypatch.setattr(nearest, "SIMILARITIES", 1000)
    monkeypatch.setattr(nearest, "_compared", lambda df, k, width: (sent.append(df.count()), compared(df, k, width))[1])
    got = nearest.nearest(spark.createDataFrame(rows, "id long, v array<double>"), 5).collect()
    assert {(x["id"], x["rank"], x["neighbour"], round(x["similarity"], 6) + 0.0) for x in got} == plain_nearest(rows, 5)
    assert sum(sent) <= 600 * 3 * nearest.CELLS


def test_nearest_of_few(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert nearest.nearest(make([])).collect() == []
    assert nearest.nearest(make([(1, [1.0, 0.0])])).collect() == []
    got = nearest.nearest(make([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]), 5)
    assert {tuple(x) for x in got.collect()} == {(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)}


def infra_sides(spark, n_hosts, banner_of):
    from duskwire import schemas

    hosts = [(f"h{i}.example.com", [], None, f"fav{i}", banner_of(i), {}, [], None, None) for i in range(n_hosts)]
    onions = [(f"o{i}.onion", [f"h{i}.example.com", "*.le.com" if i == 0 else "x.org"], None, f"fav{i}", "Stock/1.0", {}, [], None, None, None) for i in range(5)]
    return spark.createDataFrame(onions, schemas.ONION), spark.createDataFrame(hosts, schemas.HOST)


def test_findings_read_each_side_once(spark, tmp_path):
    from duskwire.operators import infra

    onions, hosts = infra_sides(spark, 30, lambda i: None)
    onions.write.parquet(str(tmp_path / "o"))
    hosts.write.parquet(str(tmp_path / "h"))
    found = infra.all_findings(spark.read.parquet(str(tmp_path / "o")), spark.read.parquet(str(tmp_path / "h")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    kinds = {(r["detector_id"], r["onion_address"], r["clearnet_match"], r["confidence"]) for r in found.collect()}
    want = {("D1", f"o{i}.onion", f"h{i}.example.com", 0.95) for i in range(5)} | {("D2", f"o{i}.onion", f"h{i}.example.com", 0.7) for i in range(5)}
    want |= {("D1", "o0.onion", f"h{i}.example.com", 0.9) for i in range(30)}
    assert kinds == want


def test_a_stock_value_has_linear_groups(spark):
    """A banner of a third of all hosts: a row for each member, not for each pair."""
    from duskwire.operators import infra

    onions, hosts = infra_sides(spark, 300, lambda i: "stock/1.0 " if i % 3 == 0 else f"own{i}")
    groups = infra.shared_values(onions, hosts, ["D3"]).collect()
    assert sorted({(g["n_onions"], g["n_hosts"]) for g in groups}) == [(5, 100)] and len(groups) == 105
    assert {g["member"] for g in groups if g["side"] == "onion"} == {f"o{i}.onion" for i in range(5)}
    assert infra.findings(onions, hosts, ["D3"]).count() == 500


def test_favicon_groups_are_linear(spark):
    from duskwire.operators import infra

    nodes = spark.createDataFrame([(f"n{i}", "stock" if i % 3 == 0 else f"f{i}") for i in range(90)] + [("z", None)], "id string, favicon_hash string")
    rows = infra.favicon_groups(nodes).collect()
    assert len(rows) == 30 and {r["members"] for r in rows} == {30}


def test_block_search_equals_a_scan_and_skips_blocks(spark):
    from duskwire.operators import search

    r = np.random.default_rng(8)
    words = ["alpha", "beta", *[f"w{i}" for i in range(60)]]
    weights = np.array([0.08, 0.03] + [0.89 / 60] * 60)
    texts = [" ".join(r.choice(words, size=int(r.integers(5, 200)), p=weights)) for _ in range(600)] + ["", "alpha beta", "alpha beta"]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    index = search.block_index(posts, block=8)
    sizes = index.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    assert all(x["most"] <= 8 for x in sizes)
    for query, limit in (("alpha beta", 5), ("Beta", 3), ("alpha w3 beta", 4), ("alpha missing", 5), ("alpha", 1000)):
        hits, blocks = search.best_posts(index, posts, query, limit)
        want = [tuple(x) for x in search.posts(posts, query, limit).select("post_id", "rank", "snippet").collect()]
        assert [tuple(x) for x in hits.select("post_id", "rank", "snippet").collect()] == want, query
        read = blocks.agg(F.count_if("read").alias("r"), F.count("*").alias("n")).first()
        if query in ("alpha beta", "Beta"):
            assert 0 < read["r"] < 0.5 * read["n"], "blocks must be skipped"
    assert search.best_posts(search.block_index(posts.limit(0)), posts.limit(0), "alpha")[0].collect() == []


@pytest.mark.parametrize("chunk", [3, 128])
def test_interval_join_equals_all_pairs(spark, chunk):
    from duskwire.operators import intervals

    r = np.random.default_rng(9)
    points = [(f"p{i}", int(r.integers(0, 60)) if i % 2 else 7) for i in range(120)] + [("none", None)]  # half at one value
    spans = [(f"i{i}", int(lo := r.integers(-5, 60)), int(lo + r.integers(-2, 12))) for i in range(60)] + [("n1", None, 3), ("n2", 3, None), ("p1", 7, 7)]
    ranks, ends = intervals.ranked(spark.createDataFrame(points, "id string, at long").repartition(3), spark.createDataFrame(spans, "id string, lo long, hi long"))
    want = {(p, i) for p, x in points for i, lo, hi in spans if x is not None and lo is not None and hi is not None and lo <= x <= hi}
    got = [tuple(x) for x in intervals.pairs(ranks, ends, chunk).collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted(x["rank"] for x in ranks.collect()) == list(range(120))
    counts = {x["id"]: x["after"] - x["first"] for x in ends.collect()}
    assert counts == {i: sum(j == i for _, j in want) for i, lo, hi in spans if lo is not None and hi is not None}
    sizes = [x["count"] for x in ranks.groupBy(F.floor(F.col("rank") / chunk)).count().collect()]
    assert max(sizes) <= chunk, "equal chunks, however many rows share a value"


def test_interval_join_of_nothing(spark):
    from duskwire.operators import intervals

    ranks, ends = intervals.ranked(spark.createDataFrame([], "id string, at long"), spark.createDataFrame([("a", 1, 2)], "id string, lo long, hi long"))
    assert ranks.collect() == [] and [tuple(x) for x in ends.collect()] == [("a", 0, 0)] and intervals.pairs(ranks, ends).collect() == []


def test_pairs_bring_their_marks_along(spark, monkeypatch):
    """Marks come out of the tiles, no join follows them; pieces of a tile give the same pairs."""
    rows = random_sparse(4, 70)
    marks = spark.createDataFrame([(i, i * 10) for i, _ in rows], "id long, mark long")
    plain = {(r["a"], r["b"]): round(r["similarity"], 9) for r in cosine_join.similar_pairs(sparse(spark, rows), 0.4).collect()}
    df = cosine_join.similar_pairs(sparse(spark, rows), 0.4, 40, marks)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    got = df.collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == plain and len(got) == len(plain) > 0
    assert all(r["a_mark"] == 10 * r["a"] and r["b_mark"] == 10 * r["b"] for r in got)
    # small pieces and slabs, in this process
    import pyarrow as pa

    held = [(0 if k < 40 else 1, i, sorted(v), [v[t] for t in sorted(v)], i * 10) for k, (i, v) in enumerate(rows)]
    monkeypatch.setattr(cosine_join, "PIECE", 7)
    monkeypatch.setattr(cosine_join, "SLAB", 50)
    out = {}
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        part = [r for r in held if r[0] in (lo, hi)]
        table = pa.table({n: pa.array([r[c] for r in part]) for c, n in enumerate(["block", "id", "terms", "weights", "mark"])})
        for b in cosine_join._tile(0.4)((pa.scalar(lo), pa.scalar(hi)), iter(table.to_batches(10))):
            assert b.num_rows <= 49
            out.update({(r["a"], r["b"]): round(r["similarity"], 9) for r in b.to_pylist()})
    assert out == plain


def test_visits_are_returned_in_small_batches(spark):
    """A vector may visit every cell: its visits leave the task in batches of a bounded size, and nothing is lost."""
    from unittest import mock

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    seen = []
    plain = type(df).mapInArrow

    def watched(self, fn, schema):
        if "home" in schema:
            batch = self.coalesce(1).toArrow().combine_chunks().to_batches()
            seen.extend(b.num_rows for b in fn(iter(batch)))
        return plain(self, fn, schema)

    with mock.patch.object(type(df), "mapInArrow", watched), mock.patch.object(nearest, "VISIT_ROWS", 16), mock.patch.object(nearest, "VISITS", 20):
        got = {(x["id"], x["rank"], x["neighbour"]) for x in nearest.nearest(df, 3, 10).collect()}
    assert len(seen) > 5 and max(seen) <= 20
    want = set()
    v = np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -2)
    for i in range(90):
        want |= {(i, n + 1, int(j)) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}
    assert got == want


def test_blocks_of_frequent_tokens_are_dealt_by_impact(spark):
    from duskwire.operators import search

    r = np.random.default_rng(5)
    texts = ["alpha " * int(r.integers(1, 4)) + "beta " * int(i % 3 == 0) + "w " * int(r.integers(0, 90)) for i in range(400)] + ["alpha beta copy"] * 200
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    index = search.block_index(posts, block=8, often=100)
    for token in ("alpha", "beta", "copy"):
        rows = index.filter(F.col("token") == token).orderBy("block").collect()
        assert [x["block"] for x in rows] == list(range(len(rows))) and all(x["n"] == len(x["postings"]) <= 8 for x in rows)
        listed = [p["impact"] for x in rows for p in x["postings"]]
        assert listed == sorted(listed, reverse=True) and len(listed) == sum(token in t.split() for t in texts)
    for query, limit in (("alpha beta", 5), ("copy", 50), ("alpha", 1000)):
        want = [tuple(x) for x in search.posts(posts, query, limit).select("post_id", "rank").collect()]
        assert [tuple(x) for x in search.best_posts(index, posts, query, limit)[0].select("post_id", "rank").collect()] == want


def test_terms_are_counted_in_their_row(spark):
    from duskwire.operators import search, stylometry

    docs = spark.createDataFrame([(1, "b a b c b a"), (2, ""), (3, None), (4, "solo")], "post_id long, text string")
    index = search.token_index(docs)
    terms = stylometry.word_terms(docs, [], "post_id")
    for df in (index, terms):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in index.collect()} == {("a", 1, 2, 6), ("b", 1, 3, 6), ("c", 1, 1, 6), ("solo", 4, 1, 1)}
    pairs = spark.createDataFrame([(1, "bb aa bb aa"), (2, "")], "post_id long, text string")
    assert {tuple(x) for x in stylometry.word_terms(pairs, [], "post_id").collect()} == {(1, "aa", 2), (1, "bb", 2), (1, "bb aa", 2), (1, "aa bb", 1)}


def test_rows_of_one_id_are_one_document(spark):
    """As in SQL, which counts by id and term: a term of an id in several rows has one row and adds one to df."""
    from duskwire.operators import stylometry

    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "bb"), (None, "aa"), (None, "aa cc")], "doc_id long, text string")
    terms = stylometry.word_terms(docs, [])
    want = [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 1), (2, "bb", 1), (None, "aa", 2), (None, "aa cc", 1), (None, "cc", 1)]
    assert sorted(map(str, (tuple(x) for x in terms.collect()))) == sorted(map(str, want))
    fitted = {x["term"]: (x["cf"], x["df"]) for x in stylometry.fit_vocabulary(terms, 5).collect()}
    assert fitted == {"aa": (4, 2), "aa bb": (1, 1), "bb": (2, 2), "aa cc": (1, 1), "cc": (1, 1)}
