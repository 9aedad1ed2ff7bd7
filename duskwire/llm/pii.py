"""Personal data by fixed forms and by bootstrapped contextual extraction.

The fixed forms (e-mail, IP, card, phone) are the seeds. Each stands in lexical patterns: the word before
it, the word after it, and both; its shape is a pattern of little weight. Spark scores the graph between patterns and
instances in rounds: a pattern is worth the share of its instances that are known, an instance is worth
what its patterns say together. Patterns of high worth name identifiers that no form covers.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .postings import column

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

# The forms. A run of the leading class is entered at its beginning only: a search that starts inside it
# could not match what the run itself does not.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What may be an identifier beyond the forms: a run that holds a digit, an @ or a bracketed "at", digits parted
#: by blanks, or words around a bracketed one.
_NUMBER = r"[+(\[]{0,3}+[0-9][0-9()\[\]./-]*+(?![A-Za-z@_%+])"
_WORD = r"[A-Za-z0-9@._%+-]++"
#: What holds no candidate is passed over within the pattern: words of letters and marks that nothing else follows, and
#: characters that begin no candidate. A lone bracket and the end of the text are matched so that a search never starts again.
_PLAIN = r"[A-Za-z._%+-]++(?![0-9@()\[{]|\x20[(\[{])|[^A-Za-z0-9@._%+()\[-]++"
_CANDIDATE = re.compile(
    rf"(?:{_PLAIN})*+({_NUMBER}(?:\x20{{1,2}}{_NUMBER})*+|{_WORD}(?:\x20?[(\[{{]\x20?[A-Za-z]++\x20?[)\]}}]\x20?{_WORD})++|[A-Za-z0-9@._%+()-]++|\[|\Z)"
)
_AT = re.compile(r"[(\[{]\x20?at\x20?[)\]}]", re.I)
_PIECE = re.compile(r"[^\x20]++")
#: The most that a shape alone is worth, which is too little to promote or to extract.
_SHAPE_WORTH = 0.3
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*\Z")
_WORD_AFTER = re.compile(r"[^\w]*([^\W\d_]+)")
_NEAR = 40

FOUND = (
    "doc_id long, key long, base array<struct<start:long,kind:int,end:long>>, "
    "seen array<struct<start:long,end:long,kind:int,chain:long,instance:long,before:long,after:long,both:long,form:long>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, by start and kind; code points."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shape(value: str) -> str:
    """Letters as a, digits as 9, runs of one kind once, with their length up to a power of two."""
    out = []
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|.", value, re.S):
        run = m[0]
        out.append((f"a{len(run).bit_length()}" if run[0].isalpha() else f"9{len(run).bit_length()}") if run[0].isalnum() else run)
    return "".join(out) if len(out) < 12 else "".join(dict.fromkeys(x[0] for x in out)) + str(len(value).bit_length())


def candidates(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, chain) of what may be an identifier and overlaps nothing ``covered``.

    Pieces parted by blanks are listed together and each alone, with the place of the first as their chain.
    """
    k = 0
    for m in _CANDIDATE.finditer(text):
        runs: list[list[tuple[int, int]]] = [[]]
        for piece in _PIECE.finditer(text, *m.span(1)):
            a, z = piece.span()
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if k < len(covered) and covered[k][0] < z:
                runs.append([])
            else:
                runs[-1].append((a, z))
        for run in runs:
            for a, z in {(run[0][0], run[-1][1]), *run} if run else ():
                while z > a and text[z - 1] in "._-(%+":
                    z -= 1
                if z - a >= 6 and ("@" in text[a:z] or _DIGIT.search(text, a, z) or _AT.search(text, a, z)):
                    yield a, z, run[0][0]


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind or -1, chain, instance, before, after, both, form) of seeds and of other candidates.

    The patterns are hashes of the nearest word on one side, of those on both, and of the shape.
    """
    spans = [(a, z, k, a) for a, k, z in base]
    if "@" in text or _DIGIT.search(text) or _AT.search(text):
        spans += [(a, z, -1, chain) for a, z, chain in candidates(text, sorted((a, z) for a, z, *_ in spans))]
    out = []
    for a, z, kind, chain in spans:
        value = text[a:z]
        before = _WORD_BEFORE.search(text, max(0, a - _NEAR), a)
        after = _WORD_AFTER.match(text, z, z + _NEAR)
        out.append((
            a, z, kind, chain, _hash(value.lower()),
            _hash("b", before[1].lower()) if before else None, _hash("a", after[1].lower()) if after else None,
            _hash("ba", before[1].lower(), after[1].lower()) if before and after else None, _hash("s", shape(value)),
        ))
    return out


def key_of() -> Column:
    """Tells rows apart by id and text; a null id is like no other."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text")


def find(docs: DataFrame) -> DataFrame:
    """Fixed forms and all occurrences per row of ``docs``, with a row number of its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        names = ("start", "end", "kind", "chain", "instance", "before", "after", "both", "form")
        seen_kind = pa.list_(pa.struct([(n, pa.int32() if n == "kind" else pa.int64()) for n in names]))
        for b in batches:
            bases, seen = [], []
            for t in column(b, "text").to_pylist():
                base = base_spans(t) if t else []
                bases.append([{"start": a, "kind": k, "end": z} for a, k, z in base])
                seen.append([dict(zip(names, o, strict=True)) for o in (occurrences(t, base) if t else [])])
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), column(b, "key"), pa.array(bases, base_kind), pa.array(seen, seen_kind)],
                ["doc_id", "key", "base", "seen"],
            )

    return docs.select("doc_id", key_of().alias("key"), "text").mapInArrow(scan, FOUND).withColumn("row", F.monotonically_increasing_id())


def pattern_scores(graph: DataFrame, seeds: DataFrame, rounds: int | None, support: int, bar: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Worth of patterns (pattern, kind, worth) and of instances (instance, kind, worth).

    ``graph``: distinct (pattern, instance, weak). A weak pattern is worth ``_SHAPE_WORTH`` at most. ``seeds``:
    distinct (instance, kind). In each round a pattern's worth for a kind is the mean worth of its instances; it
    counts with ``support`` instances or more that are seeds or were worth ``bar`` in the round before. An
    instance is worth 1 - product of (1 - worth) over its patterns, a seed 1. Worth never falls, so rounds go on
    until no pattern and no instance is new; ``rounds`` ends them earlier.
    """
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("weak").alias("capped"))
    # patterns with too few instances never count: they are left out once, and the rest bring their size along
    sized = cut_lineage(graph.join(sizes.filter(F.col("n") >= support), "pattern").select("pattern", "instance", "n", "capped"), "pii-sized")
    others = cut_lineage(sized.join(seeds, "instance", "left_anti").select("pattern", "instance"), "pii-others")
    known = seeds.withColumn("worth", F.lit(1.0))
    k, before = 0, None
    while True:
        counted = (
            sized.join(known, "instance").groupBy("pattern", "kind", "n", "capped")
            .agg(F.sum("worth").alias("total"), F.sum((F.col("worth") >= bar).cast("int")).alias("sure"))
            .filter(F.col("sure") >= support)
        )
        patterns = cut_lineage(counted.select(
            "pattern", "kind", F.least(F.col("total") / F.col("n"), F.when(F.col("capped"), F.lit(_SHAPE_WORTH))).alias("worth")), "pii-patterns"
        )
        k += 1
        if k == rounds:
            break
        told = others.join(patterns, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("worth"))
        told = cut_lineage(told.filter("worth >= 0.5").withColumn("worth", F.least("worth", F.lit(0.999))), "pii-told")
        known = seeds.withColumn("worth", F.lit(1.0)).unionByName(told)
        # one row: patterns, instances and their worth in hundredths
        summed = [F.count(F.lit(1)), F.sum(F.floor(F.col("worth") * 100))]
        now = patterns.agg(*summed).join(told.agg(*summed)).first()
        if now == before:
            break
        before = now
    return patterns, known


def joined(spans: Column) -> Column:
    """kind:start:end of spans by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def extracted(docs: DataFrame, rounds: int | None = None, support: int = 3, worth: float = 0.8) -> DataFrame:
    """Spans per row of ``docs`` (doc_id, text): doc_id, key, row, base, spans as arrays of (start, kind, end).

    Null and empty texts have none. Repeated rows and null ids each give a row; other columns are ignored.
    Spans beyond the fixed forms have the kind whose patterns named them and overlap no form.
    """
    found = cut_lineage(find(docs), "pii-found")
    each = found.select("row", F.explode("seen").alias("o")).select("row", "o.*")
    sides = each.select("row", "start", "end", "kind", "chain", "instance", F.explode(F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("pattern"), F.lit(c == "form").alias("weak"))) for c in ("before", "after", "both", "form")]
    ))).alias("p")).select("*", "p.*").drop("p")
    graph = cut_lineage(sides.select("pattern", "instance", "weak").distinct(), "pii-graph")
    seeds = each.filter("kind >= 0").select("instance", "kind").distinct()
    patterns, _ = pattern_scores(graph, seeds, rounds, support)
    best = (
        sides.filter("kind < 0").join(patterns.withColumnRenamed("kind", "told"), "pattern")
        .groupBy("row", "chain", "start", "end", "told").agg((1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("w"))
        .filter(F.col("w") >= worth)
        .groupBy("row", "chain", "start", "end").agg(F.min_by("told", F.struct(-F.col("w"), F.col("told"))).alias("kind"))
        # pieces inside a longer span of theirs give way to it; the longest starts first
        .groupBy("row", "chain").agg(F.collect_list(F.struct("start", "kind", "end")).alias("some"))
        .withColumn("most", F.array_max(F.transform("some", lambda x: x["end"] - x["start"])))
        .withColumn("long", F.filter("some", lambda x: x["end"] - x["start"] == F.col("most"))[0])
        .withColumn("some", F.filter("some", lambda x: (x == F.col("long")) | (x["end"] <= F.col("long.start")) | (x["start"] >= F.col("long.end"))))
        .groupBy("row").agg(F.flatten(F.collect_list("some")).alias("more"))
    )
    return found.join(best, "row", "left").select(
        "doc_id", "key", "row", "base", F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)"))).alias("spans"),
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the fixed forms, their digest, and all spans per row of ``docs``."""
    rows = extracted(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``spans``: key, spans of ``extracted``.
    """
    some = spans.filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("_spans")).withColumnRenamed("key", "_key")
    parts = docs.withColumn("_key", key_of()).join(some, "_key", "left")
    # fold over the spans by start: (end of the last one, text so far)
    folded = F.aggregate(
        F.array_sort("_spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(
                F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit("["), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit("]"))).otherwise(F.lit(""))).alias("out"),
        )),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(folded)
    return parts.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
