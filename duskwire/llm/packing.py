"""Bounded-space online packing of tokenized documents into sequences of fixed length.

Each partition keeps ``open_windows`` windows open. A document fills whole windows first; its rest goes
where it leaves the least room. If it fits nowhere, the fullest window is closed and a new one opened.
The windows still open at the end of the partitions are merged in bundles, largest first.

Token ids are those of a public tokenizer file. Its splitting never looks across a blank, so ids are kept
per blank-separated chunk and, below that, per pretoken: a text costs dictionary look-ups, and only
new words reach the tokenizer's model.
"""
from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .postings import column

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"
)
#: Characters of texts that are looked up together.
TOGETHER = 1 << 21
#: The tokenizer's own pattern for pretokens, for lower-case ASCII.
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Letters whose lower case depends on nothing around them and which stay composed.
_PLAIN = re.compile("[^\x00-įı-ɏ]")


class _Known(dict):
    """A dictionary that works out what it doesn't hold yet, once."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Chunks and pretokens are remembered up to ``remembered`` entries each; then the memory starts anew.
    """

    _kept: dict[str, "Tokens"] = {}

    def __init__(self, path: str, remembered: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.chunks = _Known(self.of_chunk)
        self.words = _Known(self.of_word)

    @classmethod
    def of(cls, path: str) -> "Tokens":
        """One per worker process, so that later tasks find the words of earlier ones."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        """Ids of a pretoken as the splitter returns it."""
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two blanks.

        A printable ASCII character stands for itself in a pretoken, so for such chunks the splitter's pattern alone
        tells the pretokens; letters only are one pretoken.
        """
        words = self.words
        if chunk.isascii():
            if chunk.isalpha():
                return words[chunk.lower()]
            if chunk.isprintable():
                return b"".join([words[w] for w in _ASCII_PARTS.findall(chunk.lower())])
        if not chunk.isascii() and _PLAIN.search(chunk):
            return self.whole(chunk)
        return b"".join([words[w] for w, _ in self.split(chunk.lower())])

    def of_plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without special tokens. Each chunk that occurs in them is looked up once."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        known = list(map(self.chunks.__getitem__, coded.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        begin = np.cumsum(size) - size
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[chunk]
        ends = np.cumsum(sizes)
        # the ids of all chunks in turn: a run of consecutive places of ``flat`` for each
        place = np.repeat(begin[chunk] - (ends - sizes), sizes)
        place += np.arange(len(place))
        ids = flat[place]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[lo:hi].tobytes()

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; null is empty."""
        texts = [t or "" for t in texts]
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= TOGETHER):
                held += len(texts[hi])
                hi += 1
            odd = {i for i in range(lo, hi) if "<|" in texts[i] and self.special.search(texts[i])}
            plain = self.of_plain([
                (t.lower() if t.isascii() or not _PLAIN.search(t) else t).replace("\n", " ")
                for t in ("" if i in odd else texts[i] for i in range(lo, hi))
            ])
            for i, ids in zip(range(lo, hi), plain, strict=True):
                yield self.whole(texts[i]) if i in odd else ids
            for known in (self.chunks, self.words):
                if len(known) > self.remembered:
                    known.clear()
            # workers live on: what this group needed goes back
            pa.default_memory_pool().release_unused()
            lo = hi


class Windows:
    """Open windows by free room; each is (free, number)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.next = size, most, 0
        self.rooms: list[tuple[int, int]] = []

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece: best fit, or a new window after closing the fullest one."""
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            free, number = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                self.rooms.pop(0)
            free, number = self.size, self.next
            self.next += 1
        if free > length:
            insort(self.rooms, (free - length, number))
        return number, self.size - free


def packed(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, open_windows: int = 64, bundle: int = 32) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs``: doc_id, text; each row is a document of its own, null ids, repeated rows and empty or null
    texts (the end id alone) included. Other columns are ignored.
    """
    import struct

    last = struct.pack("<I", end)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        ids_of = Tokens.of(tokenizer)
        windows = Windows(size, open_windows)
        whole_from = 1 << 31
        whole = 0

        def rows_of(batch):
            nonlocal whole
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), ids_of.many(column(batch, "text").to_pylist()), strict=True):
                ids += last
                n = len(ids) // 4
                full = n - n % size
                seen = memoryview(ids)
                for start in range(0, full, size):
                    yield doc, start, size, zlib.crc32(seen[4 * start : 4 * (start + size)]), n, base + whole_from + whole, 0
                    whole += 1
                if n > full:
                    number, offset = windows.place(n - full)
                    yield doc, full, n - full, zlib.crc32(seen[4 * full :]), n, base + number, offset

        kinds = [pa.int64()] * 7

        def out(cols, is_open):
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + [pa.array(is_open, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

        # pieces of open windows wait: their number is bounded by the windows' size
        waiting: dict[int, list[tuple]] = {}
        for b in batches:
            done: list[tuple] = []
            for r in rows_of(b):
                if r[5] - base >= whole_from:
                    done.append(r)
                else:
                    waiting.setdefault(r[5], []).append(r)
            still = {base + number for _, number in windows.rooms}
            for number in [x for x in waiting if x not in still]:
                done += waiting.pop(number)
            if done:
                yield out(list(zip(*done, strict=True)), [False] * len(done))
        rest = [r for some in waiting.values() for r in some]
        if rest:
            yield out(list(zip(*rest, strict=True)), [True] * len(rest))

    pieces = cut_lineage(docs.select("doc_id", "text").mapInArrow(fill, PIECES), "packing")
    opened = pieces.filter("open").groupBy("window").agg(F.sum("length").alias("used"))
    bundled = opened.withColumn("bundle", F.expr(f"window div {bundle << 32}"))

    def merge(table: pa.Table) -> pa.Table:
        windows = sorted(zip(table.column("used").to_pylist(), table.column("window").to_pylist(), strict=True), reverse=True)
        merged = Windows(size, len(windows))
        first: dict[int, int] = {}
        into, base = [], []
        for used, number in windows:
            target, offset = merged.place(used)
            into.append(first.setdefault(target, number))
            base.append(offset)
        return pa.table({"window": pa.array([n for _, n in windows], pa.int64()), "into": pa.array(into, pa.int64()),
                         "base": pa.array(base, pa.int64())})

    moved = bundled.groupBy("bundle").applyInArrow(merge, "window long, into long, base long")
    return pieces.join(moved, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("into", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
