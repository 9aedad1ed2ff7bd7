"""Benchmark decontamination by size-partitioned MinHash containment search.

Jaccard sketches lose a short item inside a long document, so the sketch is asymmetric: items are parted by
size, every part has sketches of its own length, and a document is asked whether it holds the item's smallest
hashes. An item of q shingles keeps its q - ceil(t q) + 1 smallest: a document that holds none of them lacks
too many shingles to contain the share t, so no containing document is missed. Documents too small for a
part skip it. Every hit is verified by exact shingle containment in the same pass.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import bytes_of, column
from .words import MARKS, shingle_hashes, shingle_sets, spans, word_hashes

FOUND = "doc_id long, item_id long, n_item long, n_shared long, containment double"


class Items:
    """Sketches of a block of items: per shingle width and size part, the hashes to probe and who has them."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int, percent: int):
        self.ids = ids
        self.sets = list(shingle_sets(texts, width, MARKS))
        n_words = np.diff(word_hashes(texts, MARKS)[1]) if texts else np.zeros(0, np.int64)
        #: Least overlap, by item.
        self.least = [-(-percent * len(s) // 100) for s in self.sets]
        parts: dict[tuple[int, int], tuple[list, list]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                sketch = s[: len(s) - self.least[k] + 1]
                h, who = parts.setdefault((min(width, int(n_words[k])), int(math.log2(len(s)))), ([], []))
                h.append(sketch)
                who.append(np.full(len(sketch), k))
        #: (width, least overlap in the part, largest hash, hashes, their items), by width.
        self.parts = []
        for (w, _), (h, who) in sorted(parts.items()):
            h, who = np.concatenate(h), np.concatenate(who)
            order = np.argsort(h, kind="stable")
            self.parts.append((w, min(self.least[k] for k in who), h[order][-1], h[order], who[order]))

    def candidates(self, words: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, width) where a text holds one of the item's smallest hashes."""
        every: dict[int, np.ndarray] = {}
        for w, least, top, sketch, who in self.parts:
            h = every.setdefault(w, shingle_hashes(words, w))
            # a document's own sketch: its hashes up to the largest of the part
            at = np.flatnonzero(h <= top)
            lo, hi = np.searchsorted(sketch, h[at], "left"), np.searchsorted(sketch, h[at], "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            doc = np.searchsorted(bound, at, side="right") - 1
            big = (at + w <= bound[doc + 1]) & (bound[doc + 1] - bound[doc] - w + 1 >= least)
            pairs = {(d, int(who[x])) for d, a, b in zip(doc[big].tolist(), lo[big].tolist(), hi[big].tolist(), strict=True) for x in range(a, b)}
            for d, k in sorted(pairs):
                yield d, k, w

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, overlap) of every text that contains the needed share of an item."""
        for lo, hi in spans(texts):
            words, bound = word_hashes(texts[lo:hi], MARKS)
            held: tuple = (None, None)
            for d, k, w in self.candidates(words, bound):
                if held[0] != (d, w):
                    held = (d, w), np.unique(shingle_hashes(words[bound[d] : bound[d + 1]], w))
                mine = self.sets[k]
                at = np.searchsorted(held[1], mine)
                shared = int((held[1][np.minimum(at, len(held[1]) - 1)] == mine).sum())
                if shared >= self.least[k]:
                    yield lo + d, k, shared


def item_blocks(items: DataFrame, block_items: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of the items that have text, in blocks of about ``block_items``."""
    items = items.select("item_id", "text").filter(F.length("text") > 0)
    n_blocks = max(1, -(-items.count() // block_items))  # one number
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toArrow()
        yield block.column("item_id").to_pylist(), [t.encode() for t in block.column("text").to_pylist()]


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): documents that hold ``percent`` of an item's shingles.

    ``docs``: doc_id, text; ``items``: item_id, text. Words are runs of letters and digits with A-Z folded. An
    item of fewer than ``width`` words is one shingle of its own length; one without words is contained in
    nothing. Null texts are empty. Repeated documents or items give repeated rows. Items go to the tasks in
    blocks of about ``block_items``, every block against all documents. Other columns are ignored.
    """
    out = None
    for ids, texts in item_blocks(items, block_items):

        def search(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Items(ids, texts, width, percent)
            for b in batches:
                doc_ids = column(b, "doc_id").to_pylist()
                rows = [(doc_ids[d], ids[i], len(index.sets[i]), n, n / len(index.sets[i])) for d, i, n in index.search(bytes_of(column(b, "text")))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")]
                )

        found = docs.select("doc_id", "text").mapInArrow(search, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75, block_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that contain no item in the sense of ``contained_items``, with all their columns."""
    for ids, texts in item_blocks(items, block_items):

        def keep(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Items(ids, texts, width, percent)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[d for d, _, _ in index.search(bytes_of(column(b, "text")))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
