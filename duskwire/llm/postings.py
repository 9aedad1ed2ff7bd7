"""An inverted index of shingles, dealt over hash buckets as compact blobs.

A row of a posting table would cost more than the posting itself, so map tasks send, for every bucket,
one blob of sorted hashes and their documents. A shingle that several documents of one map batch hold
is sent once: the batch knows already that it is no unique one. So no list is longer than the number
of batches, whatever share of all rows holds the shingle.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix, shingle_sets

#: Postings that a map task gathers before it sends them.
GATHER = 1_500_000
#: Stands for a null id inside blobs.
NO_ID = -(1 << 63)
#: Bits of a hash that the index keeps. A chance agreement makes a candidate, never a link.
KEPT_BITS = 48

BLOBS = "bucket long, hashes binary, owners binary, ids binary"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_of(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    # workers live on: what earlier batches needed goes back first
    pa.default_memory_pool().release_unused()
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def ids_of(array: pa.Array) -> np.ndarray:
    return array.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending 48-bit hashes as gaps of 32 bits, or plainly where a gap is wider."""
    gaps = np.diff(h, prepend=h[:1])
    if len(h) and gaps.max() < 1 << 32:
        return b"g" + h[:1].tobytes() + gaps[1:].astype(np.uint32).tobytes()
    return b"p" + h.tobytes()


def unpack_hashes(blob: bytes) -> np.ndarray:
    if blob[:1] == b"p":
        return np.frombuffer(blob, np.uint64, offset=1)
    first = np.frombuffer(blob, np.uint64, 1, offset=1)
    gaps = np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64)


def index_blobs(batches: Iterable[tuple[np.ndarray, list[np.ndarray]]], buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Blobs of a run of (ids, sets). Bucket -1 - k holds (id, size of set, shingles known as shared)."""

    def send(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        known = np.zeros(len(sets), np.int64)
        first: dict[bytes, int] = {}
        for i, s in enumerate(sets):
            at = first.setdefault(s.tobytes(), i)
            if at != i:  # equal sets: all their shingles are shared
                known[[at, i]] = sizes[i]
        keep = np.array([i for i in first.values() if sizes[i]], np.int64)
        h = np.concatenate([sets[i] for i in keep]) if len(keep) else np.zeros(0, np.uint64)
        h >>= np.uint64(64 - KEPT_BITS)
        doc = np.repeat(keep, sizes[keep])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
        count = np.diff(start, append=len(h))
        several = np.repeat(count > 1, count)
        np.add.at(known, doc[several], 1)
        known = np.minimum(known, sizes)
        owner = np.where(count > 1, -1, doc[start])
        h = h[start]
        bucket = (h * np.uint64(buckets)) >> np.uint64(KEPT_BITS)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows: list[tuple] = [(-1 - (salt + len(sets)) % buckets, sizes.tobytes(), known.tobytes(), np.array(ids, np.int64).tobytes())]
        every = np.array(ids, np.int64)
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if hi > lo:
                mine = owner[lo:hi]
                named, place = np.unique(mine, return_inverse=True)
                kind = np.uint16 if len(named) < 1 << 16 else np.uint32
                who = np.where(named >= 0, every[named], NO_ID + 1)
                rows.append((b, pack_hashes(h[lo:hi]), place.astype(kind).tobytes(), who.tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "hashes", "owners", "ids"]
        )

    ids: list[int] = []
    sets: list[np.ndarray] = []
    size = 0
    for some, theirs in batches:
        for i, s in zip(some.tolist(), theirs, strict=True):
            ids.append(i)
            sets.append(s)
            size += len(s) + 8
            if size >= GATHER:
                yield send(ids, sets)
                ids, sets, size = [], [], 0
    if ids:
        yield send(ids, sets)


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All (hash, id) of the blobs of a bucket, by hash. Id NO_ID + 1 stands for several documents."""
    hashes, owners = [], []
    for h, o, who in zip(*(table.column(c).to_pylist() for c in ("hashes", "owners", "ids")), strict=True):
        some = unpack_hashes(h)
        kind = np.uint16 if len(o) == 2 * len(some) else np.uint32
        hashes.append(some)
        owners.append(np.frombuffer(who, np.int64)[np.frombuffer(o, kind)])
    h, doc = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    return h[order], doc[order]


def shared_counts(docs: DataFrame, width: int = 5, buckets: int | None = None) -> DataFrame:
    """(doc_id, n, shared): size of each document's shingle set and how many of them others hold too.

    ``docs``: doc_id, text. A null id counts as one document; rows of one id are one document.
    """
    n = buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for b in batches:
                ids = ids_of(column(b, "doc_id"))
                yield ids, shingle_sets(bytes_of(column(b, "text")), width)

        yield from index_blobs(sets(), n, 0)

    def count(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            parts = [np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("ids", "hashes", "owners")]
        else:
            h, doc = opened(table)
            again = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            again[1:] |= same
            again[:-1] |= same
            doc, shared = np.unique(doc[again], return_counts=True)
            real = doc != NO_ID + 1
            parts = [doc[real], np.zeros(real.sum(), np.int64), shared[real]]
        # a blob for each part of the documents, not a row for each document
        home = (mix(parts[0].view(np.uint64)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        part, first = np.unique(home[order], return_index=True)
        cols = [[x.tobytes() for x in np.split(p[order], first[1:])] if len(part) else [] for p in parts]
        return pa.table([pa.array(part, pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["part", "ids", "sizes", "shared"])

    def total(table: pa.Table) -> pa.Table:
        ids, sizes, shared = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("ids", "sizes", "shared"))
        doc, at = np.unique(ids, return_inverse=True)
        size, sums = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        np.maximum.at(size, at, sizes)
        np.add.at(sums, at, shared)
        return pa.table({"doc_id": doc, "n": size, "shared": sums})

    blobs = docs.select("doc_id", "text").mapInArrow(send, BLOBS)
    counted = blobs.groupBy("bucket").applyInArrow(count, "part long, ids binary, sizes binary, shared binary")
    return counted.groupBy("part").applyInArrow(total, "doc_id long, n long, shared long")
