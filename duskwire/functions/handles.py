"""Handle similarity: the Ratcliff-Obershelp ratio by matching blocks, as an expression and for many pairs at once.

The ratio of two strings is 2 * (characters in matching blocks) / (sum of lengths). The first block is the longest
common substring, the leftmost in the first string and then in the second; the parts to its left and to its right
are searched in the same way, from a work list. A block is found by a window that moves over the first string and grows
while the second string contains it. Where the second string has 200 characters or more, characters that make up over
one in a hundred of it begin no block, but blocks grow over them; there a block is found by dynamic programming over
one row of run lengths.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind

#: From this length of the second string on, frequent characters begin no block.
LONG = 200


def characters(s: Column) -> Column:
    """The characters of a string as an array."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1)))
    )


def common_characters(a: Column, b: Column) -> Column:
    """How many characters two strings have in common, whatever their order."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(characters(a)), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def ratio_bound(a: Column, b: Column) -> Column:
    """A cheap upper bound of ``handle_ratio``: order does not count."""
    la, lb = F.lower(a), F.lower(b)
    total = F.length(la) + F.length(lb)
    by_length = 2.0 * F.least(F.length(la), F.length(lb)) / total
    return F.when(total == 0, 1.0).otherwise(F.least(by_length, 2.0 * common_characters(la, lb) / total))


def _block(a: Column, b: Column, starts: Column, alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """struct(i, j, size) of the longest common block within the rectangle. ``starts``: which characters of b may begin one."""
    runs0 = F.transform(b, lambda _: F.lit(0))
    none = F.struct(runs0.alias("runs"), F.lit(0).alias("size"), alo.alias("i"), blo.alias("j"))

    def row(s: Column, i: Column) -> Column:
        def cell(x: Column, j: Column) -> Column:
            met = (j >= blo) & (j < bhi) & F.get(starts, j) & (x == F.get(a, i))
            return F.when(met, F.when(j > blo, F.get(s["runs"], j - 1)).otherwise(0) + 1).otherwise(0)

        def better(p: Column) -> Column:
            top = p["top"]
            at = (F.array_position(p["runs"], top) - 1).cast("int")
            longer = top > s["size"]
            return F.struct(
                p["runs"].alias("runs"), F.when(longer, top).otherwise(s["size"]).alias("size"),
                F.when(longer, i - top + 1).otherwise(s["i"]).alias("i"), F.when(longer, at - top + 1).otherwise(s["j"]).alias("j"),
            )

        return bind(bind(F.transform(b, cell), lambda r: F.struct(r.alias("runs"), F.array_max(r).alias("top"))), better)

    inside = F.when(ahi > alo, F.sequence(alo, ahi - 1)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(inside, none, row)

    def grown(f: Column) -> Column:
        """The block with the equal characters on both of its sides."""
        def run(n: Column, equal) -> Column:
            steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, F.lit(0), lambda k, d: F.when((k == d) & equal(d), k + 1).otherwise(k))

        before = run(F.least(f["i"] - alo, f["j"] - blo), lambda d: F.get(a, f["i"] - 1 - d) == F.get(b, f["j"] - 1 - d))
        after = run(
            F.least(ahi - f["i"] - f["size"], bhi - f["j"] - f["size"]),
            lambda d: F.get(a, f["i"] + f["size"] + d) == F.get(b, f["j"] + f["size"] + d),
        )
        return F.struct((f["i"] - before).alias("i"), (f["j"] - before).alias("j"), (f["size"] + before + after).alias("size"))

    return bind(found, grown)


def matched(a: Column, b: Column, starts: Column) -> Column:
    """Characters of the arrays ``a`` and ``b`` in matching blocks. ``starts``: which characters of b may begin one."""
    whole = F.struct(F.lit(0).alias("alo"), F.size(a).alias("ahi"), F.lit(0).alias("blo"), F.size(b).alias("bhi"))
    begin = F.struct(F.array(whole).alias("todo"), F.lit(0).alias("n"))

    def turn(s: Column, _: Column) -> Column:
        def split(r: Column) -> Column:
            def parts(m: Column) -> Column:
                left = F.struct(r["alo"].alias("alo"), m["i"].alias("ahi"), r["blo"].alias("blo"), m["j"].alias("bhi"))
                right = F.struct((m["i"] + m["size"]).alias("alo"), r["ahi"].alias("ahi"), (m["j"] + m["size"]).alias("blo"), r["bhi"].alias("bhi"))
                new = F.filter(F.array(left, right), lambda x: (m["size"] > 0) & (x["alo"] < x["ahi"]) & (x["blo"] < x["bhi"]))
                return F.struct(F.concat(F.slice(s["todo"], 2, F.size(s["todo"])), new).alias("todo"), (s["n"] + m["size"]).alias("n"))

            return bind(_block(a, b, starts, r["alo"], r["ahi"], r["blo"], r["bhi"]), parts)

        return F.when(F.size(s["todo"]) == 0, s).otherwise(bind(F.get(s["todo"], F.lit(0)), split))

    # a block makes two parts at most, and there are no more blocks than characters
    turns = F.sequence(F.lit(1), 2 * F.least(F.size(a), F.size(b)) + 1)
    return F.aggregate(turns, begin, turn)["n"]


def matched_in_short(a: Column, b: Column) -> Column:
    """Characters of the strings ``a`` and ``b`` in matching blocks, where every character may begin one."""
    begin = F.struct(F.array(F.struct(a.alias("x"), b.alias("y"))).alias("todo"), F.lit(0).alias("n"))

    def longest(x: Column, y: Column) -> Column:
        """struct(to, i, size) of the leftmost longest part of ``x`` that ``y`` contains."""
        start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("i"), F.lit(0).alias("size"))

        def step(w: Column, _: Column) -> Column:
            # one more character at the same place, or the next place: as many steps as characters
            longer = F.contains(y, F.substring(x, w["to"] + 1, w["size"] + 1))
            return F.when(longer, F.struct(w["to"].alias("to"), w["to"].alias("i"), (w["size"] + 1).alias("size"))).otherwise(
                F.struct((w["to"] + 1).alias("to"), w["i"].alias("i"), w["size"].alias("size"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.length(x)), start, step)

    def turn(s: Column, _: Column) -> Column:
        def split(r: Column) -> Column:
            def parts(m: Column) -> Column:
                j = F.instr(r["y"], F.substring(r["x"], m["i"] + 1, m["size"])) - 1
                left = F.struct(F.substring(r["x"], F.lit(1), m["i"]).alias("x"), F.substring(r["y"], F.lit(1), j).alias("y"))
                right = F.struct(F.substring(r["x"], m["i"] + m["size"] + 1, F.length(r["x"])).alias("x"), F.substring(r["y"], j + m["size"] + 1, F.length(r["y"])).alias("y"))
                new = F.when(m["size"] > 0, F.filter(F.array(left, right), lambda p: (p["x"] != "") & (p["y"] != "")))
                rest = F.slice(s["todo"], 2, F.size(s["todo"]))
                return F.struct(F.concat(rest, F.coalesce(new, F.filter(s["todo"], lambda p: F.lit(False)))).alias("todo"), (s["n"] + m["size"]).alias("n"))

            return bind(longest(r["x"], r["y"]), parts)

        return F.when(F.size(s["todo"]) == 0, s).otherwise(bind(F.get(s["todo"], F.lit(0)), split))

    turns = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    return F.when((a == "") | (b == ""), 0).otherwise(F.aggregate(turns, begin, turn)["n"])


def handle_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two lower-cased handles; null if one is null, 1 for two empty ones. For candidate pairs."""
    la, lb = F.lower(a), F.lower(b)
    total = F.length(la) + F.length(lb)
    often = F.floor(F.length(lb) / 100) + 1

    def of(p: Column) -> Column:
        frequent = F.transform(F.array_distinct(p["y"]), lambda c: F.struct(c.alias("c"), (F.length(lb) - F.length(F.replace(lb, c, F.lit("")))).alias("n")))
        popular = F.transform(F.filter(frequent, lambda f: f["n"] > often), lambda f: f["c"])
        starts = bind(popular, lambda out: F.transform(p["y"], lambda c: ~F.array_contains(out, c)))
        return bind(starts, lambda s: matched(p["x"], p["y"], s))

    in_long = bind(F.struct(characters(la).alias("x"), characters(lb).alias("y")), of)
    blocks = F.when(F.length(lb) < LONG, bind(F.struct(la.alias("x"), lb.alias("y")), lambda p: matched_in_short(p["x"], p["y"]))).otherwise(in_long)
    return F.when(a.isNull() | b.isNull(), None).when(total == 0, 1.0).otherwise(2.0 * blocks / total)


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of code points for each text, lengths)."""
    wide = np.array(texts, dtype=np.str_)
    return wide.view(np.int32).reshape(len(texts), -1), np.array([len(t) for t in texts], dtype=np.int32)


def _beginnings(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which characters may begin a block: in long texts not the frequent ones."""
    begins = np.ones(codes.shape, dtype=bool)
    for k in np.flatnonzero(lengths >= LONG):
        n = lengths[k]
        _, at, count = np.unique(codes[k, :n], return_inverse=True, return_counts=True)
        begins[k, :n] = count[at] <= n // 100 + 1
    return begins


def matched_in_pairs(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    """Characters of each pair of texts in matching blocks: each step takes a row of all rectangles that are left."""
    a, a_length = _codes(x)
    b, b_length = _codes(y)
    begins, long = _beginnings(b, b_length), b_length >= LONG
    total = np.zeros(len(x), dtype=np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(x)), np.zeros_like(a_length), a_length, np.zeros_like(b_length), b_length
    while True:
        some = (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = pair[some], alo[some], ahi[some], blo[some], bhi[some]
        if not len(pair):
            return total
        at = blo[:, None] + np.arange((bhi - blo).max(), dtype=np.int32)
        inside = at < bhi[:, None]
        at = np.minimum(at, b.shape[1] - 1)
        given = np.where(inside & begins[pair[:, None], at], b[pair[:, None], at], -1)
        runs = np.zeros((len(pair), given.shape[1] + 1), dtype=np.int32)
        size, i, j = np.zeros_like(alo), alo, blo
        for k in range((ahi - alo).max()):
            here = np.where(alo + k < ahi, a[pair, np.minimum(alo + k, a.shape[1] - 1)], -2)
            runs[:, 1:] = (runs[:, :-1] + 1) * (given == here[:, None])
            end = runs.argmax(axis=1).astype(np.int32)
            top = runs[np.arange(len(pair)), end]
            longer = top > size
            size, i, j = np.where(longer, top, size), np.where(longer, alo + k + 1 - top, i), np.where(longer, blo + end - top, j)
        before = after = long[pair]
        while before.any():
            before = before & (i > alo) & (j > blo) & (a[pair, i - 1] == b[pair, j - 1])
            size, i, j = size + before, i - before, j - before
        while after.any():
            p, q = np.minimum(i + size, a.shape[1] - 1), np.minimum(j + size, b.shape[1] - 1)
            after = after & (i + size < ahi) & (j + size < bhi) & (a[pair, p] == b[pair, q])
            size = size + after
        np.add.at(total, pair, size)
        met = size > 0
        left, right = (pair, alo, i, blo, j), (pair, i + size, ahi, j + size, bhi)
        pair, alo, ahi, blo, bhi = (np.concatenate([u[met], v[met]]).astype(u.dtype) for u, v in zip(left, right))


def pair_ratios(x: Sequence[str | None], y: Sequence[str | None], lot: int = 4096) -> list[float | None]:
    """``handle_ratio`` of pairs of lower-cased handles, in lots of a bounded size."""
    out: list[float | None] = []
    lot = max(1, min(lot, 1_000_000 // max(1, *(len(t or "") for t in x), *(len(t or "") for t in y)))) if x else lot
    for at in range(0, len(x), lot):
        p, q = x[at : at + lot], y[at : at + lot]
        matched = matched_in_pairs([t or "" for t in p], [t or "" for t in q])
        sizes = (len(s) + len(t) if s is not None and t is not None else None for s, t in zip(p, q))
        out += [None if n is None else 2.0 * m / n if n else 1.0 for m, n in zip(matched.tolist(), sizes)]
    return out
