"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes (A-Z folded) are cut into windows of ``STEPS`` bytes, the last one shorter. Two gated
recurrent units read each window, one from each end; both states at a byte give that byte's label probabilities,
and a document's probability of a language is the mean over all its bytes. The weights are learned in numpy by
back-propagation through time (gates and candidates squash by x / (1 + |x|), which costs a fraction of an exponential) from a bounded, balanced sample of labelled documents, in one Spark task; every
text is then read whole by tasks that share the weights, a few kilobytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .postings import bytes_of, column

#: Bytes of a window.
STEPS = 64
#: Width of each unit's state.
WIDTH = 8
#: Windows that are read side by side.
SIDE = 2048
#: Label of texts without a letter.
NONE = "und"
MODEL = "name string, shape array<int>, data binary, labels array<string>"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HAS_LETTER = r"\p{L}"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a row without an id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in the place of x. Its slope is (1 - |result|) ** 2."""
    low = np.abs(x)
    low += 1
    x /= low
    return x


def gate(x: np.ndarray) -> np.ndarray:
    """0.5 + 0.5 * squash(x), in the place of x: 0 to 1."""
    x = squash(x)
    x *= 0.5
    x += 0.5
    return x


def initial(n_labels: int, width: int = WIDTH, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights of both units (``in``: a row for each byte, ``rec``: recurrent, each for the gates z and r and the candidate c) and of the labels."""
    r = np.random.Generator(np.random.PCG64(seed))
    out: dict[str, np.ndarray] = {}
    for d in "fb":
        for g in "zrc":
            out[f"in_{d}{g}"] = r.normal(0, 0.3, (256, width)).astype(np.float32)
            out[f"rec_{d}{g}"] = r.normal(0, 1 / np.sqrt(width), (width, width)).astype(np.float32)
        out[f"out_{d}"] = r.normal(0, 0.3, (width, n_labels)).astype(np.float32)
    out["out_bias"] = np.zeros(n_labels, np.float32)
    return out


def unit(w: dict[str, np.ndarray], d: str, windows: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (step, window, width) of one unit, in the order of the bytes. A byte outside of its text leaves the state as it is.

    z = gate(in_z[byte] + h rec_z), r = gate(in_r[byte] + h rec_r), c = squash(in_c[byte] + r * (h rec_c)),
    and the next state is c + z * (h - c).
    """
    (in_z, rec_z), (in_r, rec_r), (in_c, rec_c) = ((w[f"in_{d}{g}"], w[f"rec_{d}{g}"]) for g in "zrc")
    steps, n = windows.shape[1], len(windows)
    h = np.zeros((n, len(rec_z)), rec_z.dtype)
    out = np.empty((steps, *h.shape), h.dtype)
    full = bool(inside.all())
    columns = np.ascontiguousarray(windows.T)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        byte = columns[t]
        z = h @ rec_z
        z += in_z[byte]
        z = gate(z)
        r = h @ rec_r
        r += in_r[byte]
        r = gate(r)
        u = h @ rec_c
        c = r * u
        c += in_c[byte]
        c = squash(c)
        new = h - c
        new *= z
        new += c
        if not full:
            new = np.where(inside[:, t, None], new, h)
        if keep is not None:
            keep.append((t, h, u, z, r, c))
        out[t] = new
        h = new
    return out


def byte_probabilities(w: dict[str, np.ndarray], ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """(label, byte): label probabilities of bytes from both units' states there."""
    x = w["out_f"].T @ ahead.reshape(-1, ahead.shape[-1]).T
    x += w["out_b"].T @ back.reshape(-1, back.shape[-1]).T
    x += w["out_bias"][:, None]
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def loss_and_gradients(w: dict[str, np.ndarray], windows: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of all bytes, and its gradients by back-propagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: unit(w, d, windows, inside, kept[d]) for d in "fb"}
    p = byte_probabilities(w, states["f"], states["b"])
    steps, n = windows.shape[1], len(windows)
    mask = inside.T.reshape(-1).astype(p.dtype)
    total = max(1.0, float(mask.sum()))
    wanted = np.tile(label, steps)
    at = np.arange(len(wanted))
    loss = -float((np.log(p[wanted, at] + 1e-12) * mask).sum()) / total
    p[wanted, at] -= 1.0
    p *= mask / total
    grad = {"out_bias": p.sum(axis=1)}
    for d in "fb":
        rec = {g: w[f"rec_{d}{g}"] for g in "zrc"}
        width = len(rec["z"])
        grad[f"out_{d}"] = (p @ states[d].reshape(-1, width)).T
        from_out = (p.T @ w[f"out_{d}"].T).reshape(steps, n, width)
        g_in = {g: np.zeros_like(w[f"in_{d}{g}"]) for g in "zrc"}
        g_rec = {g: np.zeros_like(rec[g]) for g in "zrc"}
        carried = np.zeros((n, width), from_out.dtype)
        for t, h, u, z, r, c in reversed(kept[d]):
            on = inside[:, t, None].astype(from_out.dtype)
            whole = carried + from_out[t]
            dh = whole * on
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            du = {"z": dz, "r": dr, "c": dc * r}
            for g, dx in (("z", dz), ("r", dr), ("c", dc)):
                np.add.at(g_in[g], windows[:, t], dx)
                g_rec[g] += h.T @ du[g]
            carried = whole * (1 - on) + dh * z + sum(du[g] @ rec[g].T for g in "zrc")
        for g in "zrc":
            grad[f"in_{d}{g}"], grad[f"rec_{d}{g}"] = g_in[g], g_rec[g]
    return loss, grad


def train(windows: np.ndarray, sizes: np.ndarray, label: np.ndarray, n_labels: int, updates: int = 300, batch: int = 256,
          rate: float = 0.02, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Weights after ``updates`` steps of Adam on random batches of windows; the same for the same input."""
    w = initial(n_labels, width)
    first = {k: np.zeros_like(x) for k, x in w.items()}
    second = {k: np.zeros_like(x) for k, x in w.items()}
    r = np.random.Generator(np.random.PCG64(9))
    for turn in range(1, updates + 1):
        some = r.integers(0, len(windows), batch)
        _, grad = loss_and_gradients(w, windows[some], np.arange(windows.shape[1]) < sizes[some, None], label[some])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        pace = rate * (1.0 - 0.9 * turn / updates)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= (pace * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return w


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, filled with zeros, and how many bytes each holds."""
    n = -(-len(text) // STEPS)
    out = np.zeros(n * STEPS, np.uint8)
    out[: len(text)] = _FOLD[np.frombuffer(text, np.uint8)]
    sizes = np.full(n, STEPS, np.int64)
    if n:
        sizes[-1] = len(text) - (n - 1) * STEPS
    return out.reshape(n, STEPS), sizes


def fit(docs: DataFrame, sample_docs: int = 400, windows_each: int = 6, train_rows: Column | None = None) -> DataFrame:
    """The model's weights (name, shape, data, labels), learned in one task.

    ``docs``: doc_id, text, lang. Rows without a text, language or id are left out, as are those that ``train_rows`` (by
    default all that are not held out) doesn't name. Of each language about ``sample_docs`` rows, those with the smallest
    hashes of their ids, give up to ``windows_each`` windows, spread evenly over the text: the bound of the sample.
    Without a usable row the model has no weights.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(~held_out() if train_rows is None else train_rows)
    known = known.filter("lang is not null and text <> ''")
    counts = known.groupBy("lang").count().collect()  # a row for each language
    reach = 1 << 30
    share = [x for r in counts for x in (F.lit(r["lang"]), F.lit(int(reach * min(1.0, sample_docs / r["count"]))))]
    if not share:
        return docs.sparkSession.createDataFrame([], MODEL)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(reach)) <= F.create_map(*share)[F.col("lang")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for text in bytes_of(column(b, "text")):
                n = -(-len(text) // STEPS)
                at = np.unique(np.linspace(0, n - 1, min(n, windows_each)).astype(np.int64)) * STEPS
                parts.append(b"".join(len(p).to_bytes(2, "little") + p.ljust(STEPS, b"\0") for p in (text[i : i + STEPS] for i in at.tolist())))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "lang"), pa.array(parts, pa.binary())], ["doc_id", "lang", "parts"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("parts", "ascending")])
        labels = sorted(set(table.column("lang").to_pylist()))
        number = {x: i for i, x in enumerate(labels)}
        blobs = table.column("parts").to_pylist()
        flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, STEPS + 2)
        label = np.repeat([number[x] for x in table.column("lang").to_pylist()], [len(x) // (STEPS + 2) for x in blobs])
        w = train(_FOLD[flat[:, 2:]], flat[:, 0] + flat[:, 1].astype(np.int64) * 256, label, len(labels))
        names = sorted(w)
        return pa.table({
            "name": pa.array(names), "shape": pa.array([list(w[k].shape) for k in names], pa.list_(pa.int32())),
            "data": pa.array([w[k].astype(np.float32).tobytes() for k in names], pa.binary()),
            "labels": pa.array([labels] * len(names), pa.list_(pa.string())),
        })

    # of repeated rows one is learned from
    rows = chosen.mapInArrow(make, "doc_id long, lang string, parts binary").distinct().withColumn("all", F.lit(0))
    return rows.groupBy("all").applyInArrow(learn, MODEL)


def document_probabilities(w: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """(text, label): the mean of the byte probabilities over all bytes; texts without bytes get zeros."""
    sums = np.zeros((len(texts), len(w["out_bias"])))
    pile: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def read(rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        # windows of one length need no test of each byte
        for full in (True, False):
            some = np.flatnonzero((sizes == STEPS) == full)
            for lo in range(0, len(some), SIDE):
                at = some[lo : lo + SIDE]
                steps = int(sizes[at].max())
                inside = np.arange(steps) < sizes[at, None]
                some_rows = rows[at, :steps]
                p = byte_probabilities(w, unit(w, "f", some_rows, inside), unit(w, "b", some_rows, inside))
                if not full:
                    p *= inside.T.reshape(-1)
                np.add.at(sums, owner[at], p.reshape(len(p), steps, len(at)).sum(axis=1, dtype=np.float64).T)

    for i, text in enumerate(texts):
        # very long texts go in pieces of whole windows, so memory stays bounded
        for lo in range(0, len(text), STEPS * SIDE * 8):
            rows, sizes = cut(text[lo : lo + STEPS * SIDE * 8])
            pile.append((rows, sizes, np.full(len(rows), i)))
            waiting += len(rows)
            if waiting >= SIDE * 8:
                read(*map(np.concatenate, zip(*pile, strict=True)))
                pile, waiting = [], 0
    if pile:
        read(*map(np.concatenate, zip(*pile, strict=True)))
    return sums / np.maximum([[len(t)] for t in texts], 1)


def languages(docs: DataFrame, model: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with lang_pred and score, one row per row.

    Texts that are null or hold no letter, and all texts where nothing was learned, are ``und`` with score 0. Otherwise
    lang_pred is the label of the highest document probability (of equal ones the first in order) and score that
    probability. Columns of ``docs`` that are named lang_pred or score are replaced. Every task gets the weights.
    """
    carry = [c for c in (carry or docs.columns) if c not in ("lang_pred", "score")]
    rows = model.toArrow().to_pylist()
    w = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in rows}
    labels = rows[0]["labels"] if rows else []
    mark = "_lettered"
    while mark in docs.columns:
        mark += "_"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = column(b, mark).to_numpy(zero_copy_only=False).astype(bool)
            found: list = [NONE] * len(lettered)
            score = np.zeros(len(lettered))
            if labels:
                texts = bytes_of(column(b, "text"))
                at = np.flatnonzero(lettered)
                p = document_probabilities(w, [texts[i] for i in at])
                best = p.argmax(axis=1)
                score[at] = np.clip(p[np.arange(len(at)), best], 0.0, 1.0)
                for i, k in zip(at.tolist(), best.tolist(), strict=True):
                    found[i] = labels[k]
            yield pa.RecordBatch.from_arrays(
                [*[column(b, c) for c in carry], pa.array(found, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"]
            )

    schema = StructType([*[docs.schema[c] for c in carry], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    lettered = F.coalesce(F.col("text").rlike(_HAS_LETTER), F.lit(False)).alias(mark)
    return docs.select(*dict.fromkeys([*carry, "text"]), lettered).mapInArrow(predict, schema)
