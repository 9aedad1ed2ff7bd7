"""Removal of repeated byte strings by sparse, distributed prefix doubling.

Doubling gives each position a name for the bytes that follow it: the name of 2k bytes is the pair of the names
of k bytes at the position and k further on, named anew, until it is unique or longer than the threshold.
Here names are 64-bit hashes of such pairs, so a task names its texts by itself, and Spark only finds which names
occur again. A row for each position and round would be many times the input; so rounds run on
what can still repeat:

1. 50 bytes. Of each 200-byte string the smallest 50-byte name stands for it. Equal strings have it at the same
   place, so strings whose smallest name is unique leave. A run of positions with one such name is one row.
2. A whole run, up to 350 bytes. Where two runs agree, all their positions repeat.
3. 100, then 200 bytes, for the positions of runs whose 50-byte name repeats, but whose whole run does not.

What one map batch holds several times is sent once, so no name gathers more rows than there are batches.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .postings import bytes_of, column
from .words import _BASE, _BYTE, _INVERSE, _PLACE, mix, powers

#: Fewest bytes of a string that counts, and of the names of the first round: a quarter of it.
LENGTH = 200
FIRST = LENGTH // 4
WINDOW = LENGTH - FIRST + 1
#: Bytes that are named together.
CHUNK = 1 << 19
#: Runs, and positions of undecided runs, that a map task gathers before it sends them.
GATHER_RUNS = 80_000
GATHER_PLACES = 200_000

RUNS = "bucket long, names binary, wholes binary, several binary, owners binary, places binary, keys binary"
MARKS = "key long, mark long"
PIECES = "bucket long, name long, key long, place long, off long, weight int, report boolean, strings binary"
RANGES = "key long, place long, n long"
_U = np.uint64


def names_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes' terms, from which any string's hash follows, and names of all FIRST-byte strings."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * powers(_BASE, n), out=sums[1:])
    m = n - FIRST + 1
    return sums, mix((sums[FIRST:] - sums[:m]) * powers(_INVERSE, m)) if m > 0 else np.zeros(0, np.uint64)


def doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of 2k bytes from those of k bytes."""
    n = len(names) - k
    return mix(names[:n] * _PLACE[0] + names[k:] * _PLACE[1]) if n > 0 else names[:0]


def smallest(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` names the place of the smallest, the first among equals."""
    value = (names & ~_U((1 << 24) - 1)) | np.arange(len(names), dtype=np.uint64)
    short = -len(value) % width
    rows = np.concatenate([value, np.full(short, ~_U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U((1 << 24) - 1)).astype(np.int64)


def text_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text, place, ok): chunks of joined texts, with the text and place of each byte; ``ok`` where
    a string of LENGTH bytes begins. A long text comes in parts that overlap by less than a string."""
    held: list[bytes] = []
    who: list[int] = []
    at: list[int] = []
    size = 0

    def out():
        lengths = np.array([len(x) for x in held])
        joined = np.frombuffer(b"".join(held), np.uint8)
        text = np.repeat(np.array(who, np.int32), lengths)
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(joined)) - np.repeat(begin - np.array(at), lengths)
        ok = np.ones(len(joined), bool)
        for z in (begin + lengths).tolist():
            ok[z - LENGTH + 1 : z] = False
        return joined, text, place, ok

    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), CHUNK):
            part = t[lo : lo + CHUNK + LENGTH - 1]
            if size and size + len(part) > CHUNK:
                yield out()
                held, who, at, size = [], [], [], 0
            held.append(part)
            who.append(i)
            at.append(lo)
            size += len(part)
    if held:
        yield out()


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, name, whole, place, off, n) of all runs: maximal stretches of string starts with one smallest name."""
    for joined, text, place, ok in text_parts(texts):
        sums, names = names_of(joined)
        least = smallest(names, WINDOW)
        p = np.flatnonzero(ok[: len(least)])
        if not len(p):
            continue
        cut = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(least[p], prepend=-1) != 0) | (np.diff(text[p], prepend=-1) != 0))
        first = p[cut]
        last = p[np.append(cut[1:], len(p)) - 1]
        off = least[first] - first
        n = last - first + 1
        shape = (n.astype(np.uint64) << _U(32)) | off.astype(np.uint64)
        whole = mix((sums[last + LENGTH] - sums[first]) * powers(_INVERSE, len(joined))[first] + shape * _PLACE[2])
        yield text[first], names[least[first]], whole, place[first], off, n


def dealt(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of names. Smallest names lie near nought, so their own high bits tell nothing."""
    return (mix(names) % _U(buckets)).astype(np.int64)


def marked(place, off, n, kind) -> np.ndarray:
    """A run in one number: place, starts, offset of the smallest name, kind (0 repeats, 1 unknown, 2 repeats and stands for others)."""
    return (np.asarray(place, np.int64) << 18) | ((np.asarray(n, np.int64) - 1) << 10) | (np.asarray(off, np.int64) << 2) | kind


def unmarked(marks: np.ndarray) -> tuple[np.ndarray, ...]:
    return marks >> 18, (marks >> 2) & 255, ((marks >> 10) & 255) + 1, marks & 3


def _first_rounds(docs: DataFrame, buckets: int) -> DataFrame:
    """Marks (key, mark) of all runs whose smallest name occurs again."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            key, name, whole, place, off, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((whole, name))
            key, name, whole, place, off, n = (x[order] for x in (key, name, whole, place, off, n))
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])])
            start = np.flatnonzero(new)
            several = np.diff(start, append=len(new)) > 1
            bucket = dealt(name[start], buckets)
            rows = []
            again = ~new
            if again.any():
                # further copies within the batch: known to repeat, they pass through
                rows.append((-1 - int(key[0]) % buckets, b"", b"", b"", b"", marked(place[again], off[again], n[again], 0).tobytes(), key[again].tobytes()))
            place = marked(place, off, n, 1)
            for b in range(buckets):
                here = np.flatnonzero(bucket == b)
                s = start[here]
                if len(s):
                    ids, owner = np.unique(key[s], return_inverse=True)
                    kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
                    rows.append((b, name[s].tobytes(), whole[s].tobytes(), several[here].tobytes(),
                                 owner.astype(kind).tobytes(), place[s].tobytes(), ids.tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], [f.split()[0] for f in RUNS.split(", ")]
            )

        for b in batches:
            keys = column(b, "key").to_numpy()
            for text, *rest in runs_of(bytes_of(column(b, "text"))):
                held.append((keys[text], *rest))
                size += len(text)
                if size >= GATHER_RUNS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def compare(table: pa.Table) -> pa.Table:
        cols = [table.column(f.split()[0]).to_pylist() for f in RUNS.split(", ")[1:]]
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"key": np.frombuffer(b"".join(cols[5]), np.int64), "mark": np.frombuffer(b"".join(cols[4]), np.int64)})
        name, whole, mark = (np.frombuffer(b"".join(cols[k]), t) for k, t in ((0, np.uint64), (1, np.uint64), (4, np.int64)))
        several = np.frombuffer(b"".join(cols[2]), bool)
        key = np.concatenate([
            np.frombuffer(ids, np.int64)[np.frombuffer(o, np.uint16 if len(o) == 2 * len(s) else np.uint32)]
            for o, ids, s in zip(cols[3], cols[5], cols[2], strict=True)
        ])
        order = np.lexsort((mark, key, whole, name))
        name, whole, mark, several, key = (x[order] for x in (name, whole, mark, several, key))
        new_name = np.concatenate([[True], name[1:] != name[:-1]])
        new_whole = new_name | np.concatenate([[True], whole[1:] != whole[:-1]])
        of_name, of_whole = np.cumsum(new_name) - 1, np.cumsum(new_whole) - 1
        weight = np.bincount(of_whole, weights=1 + several)[of_whole]
        kinds = np.bincount(of_name, weights=new_whole)[of_name]
        kind = np.where(weight < 2, 1, np.where(new_whole & (kinds > 1), 2, 0))
        keep = (weight >= 2) | (kinds > 1)
        return pa.table({"key": key[keep], "mark": (mark[keep] & ~np.int64(3)) | kind[keep]})

    return docs.select("key", "text").mapInArrow(send, RUNS).groupBy("bucket").applyInArrow(compare, MARKS)


def _last_rounds(held: DataFrame, buckets: int) -> DataFrame:
    """Ranges (key, place, n) of positions in undecided runs whose LENGTH bytes occur again."""

    def ranges(key, place):
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(key) != 0)])) if len(key) else np.zeros(0, np.int64)
        return key[new], place[new], np.diff(new, append=len(key))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            key, name, place, off, string, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            # one run's positions stay together: rows are stretches of them
            each = mix(string * _PLACE[3] + name * _PLACE[4] + off.astype(np.uint64))
            _, first, inverse, count = np.unique(each, return_index=True, return_inverse=True, return_counts=True)
            mine = np.zeros(len(each), bool)
            mine[first] = True
            several = count[inverse] > 1
            known = several & (kind == 1)
            weight = np.where(several | (kind == 2), 2, 1)
            at = np.flatnonzero(mine)
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place[at]) != 1) | (np.diff(key[at]) != 0) | (np.diff(weight[at]) != 0)
                                  | (name[at][1:] != name[at][:-1]) | (np.diff(kind[at]) != 0)])
            cut = np.append(np.flatnonzero(new), len(at))
            raw = string[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            head = at[cut[:-1]]
            k, p, n = ranges(key[known], place[known])
            cols = [
                np.concatenate([dealt(name[head], buckets).astype(np.uint64), np.full(len(k), 1 << 40, np.uint64)]).astype(np.int64),
                np.concatenate([name[head].view(np.int64), n]), np.concatenate([key[head], k]), np.concatenate([place[head], p]),
                np.concatenate([off[head], np.zeros(len(k), np.int64)]),
                np.concatenate([weight[head], np.zeros(len(k), np.int64)]).astype(np.int32),
                np.concatenate([(kind[head] == 1) & (weight[head] == 1), np.zeros(len(k), bool)]),
            ]
            # what is known already passes through, dealt over buckets of its own
            cols[0][len(head):] = -1 - np.abs(k) % buckets
            blobs = [raw[6 * a : 6 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] + [b""] * len(k)
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(blobs, pa.binary())], [f.split()[0] for f in PIECES.split(", ")])

        for b in batches:
            for key, text, marks in zip(column(b, "key").to_pylist(), bytes_of(column(b, "text")), column(b, "marks").to_pylist(), strict=True):
                place, off, n, kind = unmarked(np.sort(np.array(marks, np.int64)))
                some = np.flatnonzero(kind > 0)
                for lo in range(0, len(text), CHUNK):
                    here = some[(place[some] >= lo) & (place[some] < lo + CHUNK)]
                    if not len(here):
                        continue
                    _, names = names_of(np.frombuffer(text[lo : lo + CHUNK + LENGTH - 1], np.uint8))
                    strings = doubled(doubled(names, FIRST), 2 * FIRST)
                    count = n[here]
                    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    at = np.repeat(place[here], count) + inside
                    size += len(at)
                    parts.append((
                        np.full(len(at), key, np.int64), np.repeat(names[place[here] + off[here] - lo], count), at,
                        np.repeat(off[here], count) - inside + LENGTH, strings[at - lo], np.repeat(kind[here], count),
                    ))
                    if size >= GATHER_PLACES:
                        yield out()
                        parts, size = [], 0
        if parts:
            yield out()

    def compare(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"key": table.column("key"), "place": table.column("place"), "n": table.column("name")})
        blobs = table.column("strings").to_pylist()
        n = np.array([len(x) // 6 for x in blobs])
        raw = np.zeros((n.sum(), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = lambda c: np.repeat(table.column(c).to_numpy(), n)
        off = wide("off") - inside
        each = mix(raw.view(np.uint64).ravel() * _PLACE[5] + wide("name").view(np.uint64) * _PLACE[6] + off.astype(np.uint64))
        _, inverse = np.unique(each, return_inverse=True)
        again = np.bincount(inverse, weights=wide("weight"))[inverse] >= 2
        told = again & wide("report")
        key, place, n = ranges(wide("key")[told], (wide("place") + inside)[told])
        return pa.table({"key": key, "place": place, "n": n})

    return held.select("key", "text", "marks").mapInArrow(send, PIECES).groupBy("bucket").applyInArrow(compare, RANGES)


def repeats_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs`` (doc_id, text).

    A byte goes if it lies in a string of LENGTH bytes that also begins somewhere else, in the same text or
    another. Null text is empty. A repeated row is another text, so it repeats all of its strings. Null ids
    give rows too; other columns are ignored. Strings count as equal when their 48-bit name, the 64-bit name of
    their smallest part and its place agree.
    """
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text"))
    long = docs.filter(F.octet_length("text") >= LENGTH)
    marks = _first_rounds(long, buckets).groupBy("key").agg(F.collect_set("mark").alias("marks"))
    held = cut_lineage(long.select("key", "text").join(marks, "key").dropDuplicates(["key"]), "repeat-texts")
    more = _last_rounds(held, 2 * buckets).groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("ranges"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw, marks, ranges in zip(
                column(b, "key").to_pylist(), bytes_of(column(b, "text")), column(b, "marks").to_pylist(), column(b, "ranges").to_pylist(), strict=True
            ):
                place, _, n, kind = unmarked(np.array(marks, np.int64))
                sure = kind != 1
                edge = np.zeros(len(raw) + 1, np.int32)
                starts = np.concatenate([place[sure], np.array([r["place"] for r in ranges or ()], np.int64)])
                counts = np.concatenate([n[sure], np.array([r["n"] for r in ranges or ()], np.int64)])
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + counts - 1 + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["key", "n_removed", "n_spans", "kept"],
            )

    removed = held.join(more, "key", "left").mapInArrow(cover, "key long, n_removed long, n_spans long, kept string")
    every = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return every.join(removed, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
