"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the presence of hashed single words, word pairs, triples, pairs around one
word, and the first bytes of words, which stand for all forms of a stem. Per-coordinate rates let rare features move far; the L1 term keeps the others at nought, so the model
is a short list of weights. The learner reads a bounded sample of labelled rows (McMahan et al. 2013).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .postings import bytes_of, column
from .words import MARKS, mix, shingle_hashes, spans, word_hashes

#: Features are hashed into 2 ** BITS places; the last place is the bias.
BITS = 20
#: Bytes of a word's beginning that are features of their own.
HEADS = (4, 6)
FEATURES = "doc_id long, toxic int, features binary"
_SKIP = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a row without an id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def chunk_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per kind of feature: its places, in order, and each text's bounds among them, with the width it spans."""
    words, bound, *heads = word_hashes(texts, MARKS, HEADS)
    shift = np.uint64(64 - BITS)
    skip = mix(words[:-2] * _SKIP + words[2:]) if len(words) > 2 else words[:0]
    for width, h in (*((1, x) for x in heads), (1, mix(words)), (2, shingle_hashes(words, 2)), (3, shingle_hashes(words, 3)), (3, skip)):
        lo = np.minimum(bound[:-1], len(h))
        hi = np.minimum(np.maximum(bound[1:] - width + 1, lo), len(h))
        yield (h >> shift).astype(np.uint32), lo, hi, width


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct features of each text."""
    for a, b in spans(texts):
        kinds = list(chunk_features(texts[a:b]))
        for i in range(b - a):
            yield np.unique(np.concatenate([h[lo[i] : hi[i]] for h, lo, hi, _ in kinds]))


def train(sets: list[np.ndarray], labels: list[int], epochs: int = 5, alpha: float = 1.0, beta: float = 1.0,
          l1: float = 6.0, l2: float = 1.0, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not nought. The bias is place 2 ** BITS and free of L1.

    Features of fewer than ``least`` of the texts are left out.
    """
    n_places = (1 << BITS) + 1
    common = np.zeros(n_places, np.int64)
    for f in sets:
        common[f] += 1
    sets = [f[common[f] >= least] for f in sets]
    z, n = np.zeros(n_places), np.zeros(n_places)
    free = np.full(n_places, l1)
    free[-1] = 0.0

    def weights(f):
        zf = z[f]
        w = -(zf - np.sign(zf) * free[f]) / ((beta + np.sqrt(n[f])) / alpha + l2)
        return np.where(np.abs(zf) <= free[f], 0.0, w)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in order.permutation(len(sets)):
            f = np.append(sets[i], n_places - 1)
            w = weights(f)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = p - labels[i]
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
    w = weights(np.arange(n_places))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, train_rows: Column | None = None) -> DataFrame:
    """Weights (place, weight) learned from about ``sample_rows`` labelled rows, in one task.

    ``labels``: doc_id, toxic; null labels are left out. ``train_rows``: condition on doc_id, by default those
    not held out. The rows are those with the smallest hashes of their ids.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out() if train_rows is None else train_rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()  # one number
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, sample_rows / max(total, 1))))
    # bounded by sample_rows: a broadcast of ids and labels
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [f.tobytes() for f in features(bytes_of(column(b, "text")))]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "toxic"), pa.array(sets, pa.binary())], ["doc_id", "toxic", "features"]
            )

    def learn(table: pa.Table) -> pa.Table:
        blobs = table.column("features").combine_chunks()
        _, offsets, data = blobs.buffers()
        at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // 4
        flat = np.frombuffer(data, np.uint32, at[-1])
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        labels = table.column("toxic").to_numpy()[order].tolist()
        place, weight = train([flat[at[i] : at[i + 1]] for i in order.tolist()], labels)
        return pa.table({"place": pa.array(place, pa.int64()), "weight": pa.array(weight, pa.float64())})

    rows = some.mapInArrow(make, FEATURES).withColumn("all", F.lit(0))
    return rows.groupBy("all").applyInArrow(learn, "place long, weight double")


def scored(docs: DataFrame, weights: DataFrame, carry: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with score and predicted, one row per row.

    Null and empty texts get the score of the bias. Columns of ``docs`` that are named score or predicted
    are replaced. ``weights`` are at most 2 ** BITS + 1 rows, a few hundred after the L1 term; every task
    gets them.
    """
    carry = [c for c in (carry or docs.columns) if c not in ("score", "predicted")]
    model = weights.toArrow()
    place, weight = model.column("place").to_numpy(), model.column("weight").to_numpy()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[place] = weight
        matters = w != 0
        for b in batches:
            texts = bytes_of(column(b, "text"))
            sums = np.full(len(texts), w[-1])
            for a, z in spans(texts):
                texts_hit, places_hit = [], []
                for h, lo, hi, _ in chunk_features(texts[a:z]):
                    at = np.flatnonzero(matters[h])
                    doc = np.searchsorted(lo, at, side="right") - 1
                    inside = (doc >= 0) & (at < hi[doc])
                    texts_hit.append(doc[inside])
                    places_hit.append(h[at[inside]].astype(np.int64))
                # a feature counts once in a text
                once = np.unique(np.concatenate(texts_hit) * (1 << 32) + np.concatenate(places_hit))
                np.add.at(sums, a + (once >> 32), w[once & 0xFFFFFFFF])
            p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35.0, 35.0)))
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in carry], pa.array(p)], [*carry, "score"])

    schema = StructType([*[docs.schema[c] for c in carry], StructField("score", DoubleType())])
    out = docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(score, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
