"""Greedy longest-match token counts with a linear automaton (LinMaxMatch, Song et al. 2021).

The vocabulary is a trie over bytes. A node that no further byte can extend fails over to the node its rest
would have reached, after popping the pieces of the part before. Only the number of popped pieces is kept, so
a word's length in pieces comes from one walk over its bytes and no piece is built.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .postings import bytes_of, column

#: Follows the last byte of a word.
END = 256
COUNTS = "doc_id long, n_bytes long, n_words long, n_tokens long"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_pieces(tokens: Iterable[str], word_end: str = "</w>", special: frozenset[str] = frozenset()) -> list[tuple[int, ...]]:
    """Vocabulary entries as symbols 0..256; entries with characters outside the byte alphabet are left out."""
    symbols = byte_symbols()
    out = []
    for t in tokens:
        body, end = (t[: -len(word_end)], (END,)) if word_end and t.endswith(word_end) else (t, ())
        if t not in special and all(c in symbols for c in body):
            out.append((*[symbols[c] for c in body], *end))
    return out


class Automaton:
    """Trie with failure links; ``popped[v]`` is the number of pieces popped on failing from v."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                nxt = step[v].get(c)
                if nxt is None:
                    nxt = step[v][c] = len(step)
                    step.append({})
                    whole.append(False)
                v = nxt
            whole[v] = v != 0
        fail, popped = [-1] * len(step), [0] * len(step)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in step[u].items():
                    below.append(v)
                    if whole[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, n = fail[u], popped[u]
                    while z >= 0 and c not in step[z]:
                        n += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = step[z][c], n
            level = below
        self.step, self.fail, self.popped = step, fail, popped

    def length(self, word: bytes) -> int:
        """Pieces of greedy longest match over the word and its end; 1 if the vocabulary can't spell it."""
        step, fail, popped = self.step, self.fail, self.popped
        u = n = 0
        for c in (*word, END):
            while c not in step[u]:
                if fail[u] < 0:
                    return 1
                n += popped[u]
                u = fail[u]
            u = step[u][c]
        while u:
            if fail[u] < 0:
                return 1
            n += popped[u]
            u = fail[u]
        return n


class Lengths(dict):
    """Piece counts of words seen so far, up to ``most``; then it starts anew."""

    def __init__(self, automaton: Automaton, most: int = 500_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


_kept: dict[str, Lengths] = {}


def lengths_of(path: str, word_end: str) -> Lengths:
    """One per worker process and vocabulary file."""
    import json

    if path not in _kept:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = frozenset(t["content"] for t in spec.get("added_tokens", ()))
        _kept[path] = Lengths(Automaton(byte_pieces(spec["model"]["vocab"], word_end, special)))
    return _kept[path]


def token_counts(docs: DataFrame, vocabulary: str, word_end: str = "</w>") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) per row of ``docs`` (doc_id, text).

    ``vocabulary``: a tokenizer file with a byte-level vocabulary, present on every machine. Words are runs without
    ASCII blanks, A-Z folded; a word the vocabulary can't spell counts as one piece. Null and empty
    texts have no words. Repeated rows and null ids each give a row; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = lengths_of(vocabulary, word_end).__getitem__
        for b in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for t in bytes_of(column(b, "text")):
                words = t.lower().split()
                n_bytes.append(len(t))
                n_words.append(len(words))
                n_tokens.append(sum(map(length, words)))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in (n_bytes, n_words, n_tokens)]],
                [f.split()[0] for f in COUNTS.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(count, COUNTS)
