"""N-gram Jaccard join by T-occurrence search (DivideSkip, Li, Lu and Lu 2008).

1. An inverted index over all shingles, in hash buckets, tells how many shingles of a document others
   hold too. A partner holds three quarters of them, so a document with fewer is linked with nothing.
2. Of the others, equal sets collapse to one representative; its shingles are ranked by frequency.
   A partner shares one of the rarest n - T + 1: documents that meet there fall into one block, and no
   link crosses blocks.
3. In a block, every document asks for those that occur T times in the lists of its shingles: the short
   lists are merged through a heap with skips, the long ones are probed by binary search.
   Found documents join the asker's class and leave the lists, so a group of copies is walked once.
   Blocks above ``block_rows`` documents are cut into chunks and every pair of chunks is joined.
"""
from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..operators.graph import components
from .postings import KEPT_BITS, NO_ID, bytes_of, column, ids_of, shared_counts
from .words import shingle_sets

#: Weight of the longest list in the choice of long lists, as in the paper.
MU = 0.0085
SETS = "doc_id long, n long, print binary, hashes binary"
#: Postings of representatives that one task ranks.
PART_POSTINGS = 1_000_000


def needed(n: int, percent: int) -> int:
    """Least overlap with any partner: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def divide_skip(lists: list[list[int]], t: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Candidates of a T-occurrence search, their count in the short lists, and the long lists.

    ``lists``: ascending. Every element in ``t`` of the lists is among the candidates.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least = t - n_long
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found: list[int] = []
    counts: list[int] = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append(top)
            counts.append(len(popped))
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
            continue
        # too few lists hold it: the next that can win is not below the least-th smallest head
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        goal = heap[0][0]
        for k in popped:
            at[k] = bisect_left(short[k], goal, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    return found, counts, long


def classes(sets: list[np.ndarray], percent: int = 75) -> list[int]:
    """Class of each set: the smallest index it is linked with, directly or through others."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    out = list(range(n))
    alive = np.ones(n, bool)
    grams = np.concatenate(sets)
    _, gram = np.unique(grams, return_inverse=True)
    of = np.repeat(np.arange(n), sizes)
    bound = np.concatenate([[0], np.cumsum(sizes)])
    n_grams = int(gram.max()) + 1 if len(gram) else 0

    def lists_of_alive():
        mask = alive[of]
        g, d = gram[mask], of[mask]
        order = np.argsort(g, kind="stable")
        return np.searchsorted(g[order], np.arange(n_grams + 1)), d[order], int(alive.sum())

    start, docs, size = lists_of_alive()
    left = size
    for seed in range(n):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        queue = [seed]
        while queue:
            q = queue.pop()
            if 2 * left < size and left > 8:
                start, docs, size = lists_of_alive()
            t = needed(sizes[q], percent)
            mine = gram[bound[q] : bound[q + 1]]
            a, b = start[mine], start[mine + 1]
            lists = []
            for lo, hi in zip(a[b > a].tolist(), b[b > a].tolist(), strict=True):
                some = docs[lo:hi]
                some = some[alive[some]]
                if len(some):
                    lists.append(some.tolist())
            if not sizes[q] or len(lists) < t:
                continue
            found, counts, long = divide_skip(lists, t)
            for c, seen in zip(found, counts, strict=True):
                # 100 * overlap >= percent * (sizes - overlap)
                must = -(-percent * (sizes[q] + sizes[c]) // (100 + percent))
                rest = len(long)
                for x in reversed(long):
                    if seen >= must or seen + rest < must:
                        break
                    rest -= 1
                    k = bisect_left(x, c)
                    seen += k < len(x) and x[k] == c
                if seen >= must:
                    alive[c] = False
                    left -= 1
                    out[c] = seed
                    queue.append(c)
    return out


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Shingle sets with a 128-bit print that only equal sets share."""
    import hashlib

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ids_of(column(b, "doc_id"))
            rows = []
            for i, s in zip(ids.tolist(), shingle_sets(bytes_of(column(b, "text")), width), strict=True):
                raw = s.tobytes()
                rows.append((i, len(s), hashlib.blake2b(raw, digest_size=16).digest(), raw))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["doc_id", "n", "print", "hashes"],
            )

    return docs.select("doc_id", "text").mapInArrow(make, SETS)


def _meeting(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (src, dst) between each representative and the smallest one on each list of its rarest shingles.

    Postings go from parts of the documents to parts of the hashes and back, a blob for each pair of parts.
    """
    # one number
    total = reps.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = 1 + total // PART_POSTINGS

    def blob(h, doc, n, *more) -> tuple:
        ids, first, at = np.unique(doc, return_index=True, return_inverse=True)
        return ids.tobytes(), n[first].astype(np.int64).tobytes(), at.astype(np.uint32).tobytes(), h.tobytes(), *(x.tobytes() for x in more)

    def opened_blobs(table: pa.Table, n_more: int) -> list[np.ndarray]:
        cols = [table.column(c).to_pylist() for c in ("ids", "sizes", "at", "h", "df", "pivot")[: 4 + n_more]]
        doc, n = [], []
        for ids, sizes, at in zip(*cols[:3], strict=True):
            at = np.frombuffer(at, np.uint32)
            doc.append(np.frombuffer(ids, np.int64)[at])
            n.append(np.frombuffer(sizes, np.int64)[at])
        more = [np.frombuffer(b"".join(c), t) for c, t in zip(cols[3:], (np.uint64, np.uint32, np.int64), strict=False)]
        return [np.concatenate(doc), np.concatenate(n), *more]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in column(b, "hashes").to_pylist()]
            if not sets:
                continue
            size = np.array([len(x) for x in sets])
            h = np.concatenate(sets) >> np.uint64(64 - KEPT_BITS)
            doc, n = np.repeat(column(b, "doc_id").to_numpy(), size), np.repeat(size, size)
            part = ((h * np.uint64(parts)) >> np.uint64(KEPT_BITS)).astype(np.int64)
            rows = [(k, *blob(h[part == k], doc[part == k], n[part == k])) for k in np.unique(part).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "ids", "sizes", "at", "h"])

    def rank(table: pa.Table) -> pa.Table:
        doc, n, h = opened_blobs(table, 0)
        order = np.lexsort((doc, h))
        doc, n, h = doc[order], n[order], h[order]
        start = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
        count = np.diff(start, append=len(h))
        df, pivot = np.repeat(count, count).astype(np.uint32), np.repeat(doc[start], count)
        home = (doc.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        rows = []
        for k in range(parts):
            mine = (home == k) & (df > 1)
            if mine.any():
                rows.append((k, *blob(h[mine], doc[mine], n[mine], df[mine], pivot[mine])))
        kinds = [pa.int64()] + [pa.binary()] * 6
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "ids", "sizes", "at", "h", "df", "pivot"])

    def meet(table: pa.Table) -> pa.Table:
        doc, n, h, df, pivot = opened_blobs(table, 2)
        order = np.lexsort((h, df, doc))
        doc, n, pivot = doc[order], n[order], pivot[order]
        start = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
        count = np.diff(start, append=len(doc))
        # the document's other shingles are on no other list and come before
        nth = np.arange(len(doc)) - np.repeat(start, count) + n - np.repeat(count, count)
        rare = (nth < n + percent * n // -100 + 1) & (pivot != doc)
        src, dst = doc[rare], pivot[rare]
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        new = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]) if len(src) else np.zeros(0, bool)
        return pa.table({"src": src[new], "dst": dst[new]})

    blobs = "part long, ids binary, sizes binary, at binary, h binary"
    ranked = reps.select("doc_id", "hashes").mapInArrow(send, blobs).groupBy("part").applyInArrow(rank, blobs + ", df binary, pivot binary")
    return ranked.groupBy("part").applyInArrow(meet, "src long, dst long")


def _joined(blocks: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Edges (src, dst) that span the classes of every block. ``blocks``: doc_id, block, hashes."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    # one row; small blocks share a task
    total = sizes.agg(F.sum("rows").alias("n")).first()["n"] or 0
    bundles = 1 + total * 8 // block_rows
    cut = blocks.join(sizes, "block").withColumn("parts", F.ceil(F.col("rows") / block_rows).cast("int"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine"))))
    dealt = cut.withColumn("mine", mine).withColumn("other", other).select(
        "doc_id", "hashes", "block",
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(bundles))).otherwise(F.col("block")).alias("home"),
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.least("mine", "other")).alias("i"),
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.greatest("mine", "other")).alias("j"),
    )

    def link(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        block = table.column("block").to_numpy()
        raw = table.column("hashes").to_pylist()
        order = np.lexsort((ids, block))
        src, dst = [], []
        for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            for k, c in enumerate(classes([np.frombuffer(raw[x], np.uint64) for x in some], percent)):
                if c != k:
                    src.append(ids[some[k]])
                    dst.append(ids[some[c]])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.groupBy("home", "i", "j").applyInArrow(link, "src long, dst long")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75, block_rows: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when ``100 * intersection >= percent * union`` of their distinct ``width``-word
    shingles. With fewer words the whole sequence is one shingle; without words the set is empty and
    linked with nothing. Null text is empty. Rows of one doc_id, null included, are one document whose
    links are those of all its texts and whose size is the largest. Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    sized = cut_lineage(shared_counts(docs, width), "ngram-sizes")
    core = sized.filter((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))).select("doc_id")
    core = core.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"))
    # the same plan at every size: the list of ids grows with the documents
    some = docs.alias("d").join(core.hint("merge").alias("c"), F.expr("d.doc_id <=> c.doc_id"), "left_semi")
    sets = cut_lineage(_sets(some, width).filter("n > 0"), "ngram-sets")
    reps = cut_lineage(
        sets.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
        .groupBy("doc_id", "print").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")),
        "ngram-reps",
    )
    # a doc_id with several texts may stand for several prints: number the prints, not the documents
    keyed = reps.select(F.xxhash64("print").alias("doc_id"), "n", "hashes")
    meeting = cut_lineage(_meeting(keyed, percent), "ngram-meeting")
    blocks = components(meeting).withColumnsRenamed({"id": "doc_id", "component": "block"})
    edges = _joined(keyed.join(blocks, "doc_id").select("doc_id", "block", "hashes"), percent, block_rows)
    edges = cut_lineage(edges, "ngram-edges")
    # documents and prints in one graph: a document hangs on the prints of its texts
    held = sets.select("doc_id", F.xxhash64("print").alias("print")).distinct()
    linked = components(edges).withColumnsRenamed({"id": "print", "component": "class"})
    placed = held.join(linked, "print", "left").withColumn("class", F.coalesce("class", "print"))
    lowest = placed.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    member = placed.join(lowest, "class").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (
        sized.join(member, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"))
    )
