"""Text search over posts and graph nodes."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import bind, counted
from ..lineage import cut_lineage

TOKEN = f"[{fixed.WORD}]+"
#: A token in more posts than that has its postings dealt by impact, in steps of 1 / FALL.
OFTEN = 100_000
FALL = 256


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _hits(toks: Column, word: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == word))


def _rank(text: Column, terms: list[str]) -> Column:
    """Term hits over 1 + ln(length); 0 unless every term occurs. Local to the row."""

    def of(toks: Column) -> Column:
        counts = [_hits(toks, w) for w in terms]
        every = counts[0] > 0
        for c in counts[1:]:
            every = every & (c > 0)
        total = sum(counts[1:], counts[0])
        return F.when(every, total / (1.0 + F.ln(F.size(toks).cast("double")))).otherwise(0.0)

    return bind(tokens(text), of)


def snippet(text: Column, terms: list[str], width: int = 160) -> Column:
    """Text around the first hit with every hit marked."""
    pattern = f"(?iu){fixed.EDGE}(" + "|".join(re.escape(t) for t in terms) + f"){fixed.STOP}"
    first = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(first - F.lit(width // 2), F.lit(1))
    return F.regexp_replace(F.substring(text, start, F.lit(width)), F.lit(pattern), F.lit("<b>$1</b>"))


def posts(df: DataFrame, query: str, limit: int = 50, text: str = "text", id_: str = "post_id") -> DataFrame:
    """Top posts that contain all query terms.

    Match and rank need nothing but the row: a scan with cheap substring tests, then a top-k.
    """
    terms = query_terms(query)
    hit = df
    for t in terms:
        hit = hit.filter(F.contains(F.lower(F.col(text)), F.lit(t)))
    ranked = hit.withColumn("rank", _rank(F.col(text), terms)).filter("rank > 0")
    top = ranked.orderBy(F.desc("rank"), id_).limit(limit)
    return top.withColumn("snippet", snippet(F.col(text), terms))


def token_index(df: DataFrame, text: str = "text", id_: str = "post_id") -> DataFrame:
    """(token, post, tf, length): write it partitioned by token for repeated searches.

    A post is a row of ``df`` and counts its tokens itself; nothing is shuffled.
    """
    toks = df.select(id_, tokens(F.col(text)).alias("_t"))
    rows = toks.select(id_, F.size("_t").alias("length"), F.explode(counted(F.col("_t"))).alias("_h"))
    return rows.select(F.col("_h.value").alias("token"), id_, F.col("_h.n").alias("tf"), "length")


def search_index(index: DataFrame, query: str, limit: int = 50, id_: str = "post_id") -> DataFrame:
    """Same ranking as ``posts`` from the token index."""
    terms = query_terms(query)
    hits = index.filter(F.col("token").isin(terms))
    per_post = hits.groupBy(id_).agg(
        F.count(F.lit(1)).alias("k"), F.sum("tf").alias("tf"), F.first("length").alias("length")
    )
    rank = F.col("tf") / (1.0 + F.ln(F.col("length").cast("double")))
    return per_post.filter(F.col("k") == len(terms)).select(id_, rank.alias("rank")).orderBy(F.desc("rank"), id_).limit(limit)


def block_index(df: DataFrame, text: str = "text", id_: str = "post_id", block: int = 128, often: int = OFTEN) -> DataFrame:
    """(token, block, top, n, postings): postings of a token by falling impact, in blocks of up to ``block``.

    An impact is what a token adds to a post's rank: its hits over 1 + ln(length). ``top`` is a block's largest.
    Postings of a token in more than ``often`` posts are dealt by steps of impact, so no task holds a whole list; its blocks
    end with a step. Postings are shuffled once.
    """
    hits = token_index(df, text, id_).select("token", F.col(id_).alias("id"), (F.col("tf") / (1.0 + F.ln(F.col("length").cast("double")))).alias("impact"))
    hits = cut_lineage(hits, "postings")
    frequent = hits.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > often)
    # at most (number of postings / often) rows
    frequent = cut_lineage(frequent.select("token", F.lit(True).alias("_often")), "frequent")
    step = F.when(F.col("_often"), F.floor(-F.col("impact") * FALL)).otherwise(0).cast("long")
    dealt = hits.join(frequent, "token", "left").withColumn("_step", step)
    sizes = dealt.filter("_often").groupBy("token", "_step").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    earlier = Window.partitionBy("token").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    before = cut_lineage(sizes.select("token", "_step", F.sum("_blocks").over(earlier).alias("_before")), "steps")
    place = F.row_number().over(Window.partitionBy("token", "_step").orderBy(F.desc("impact"), "id")) - 1
    numbered = dealt.join(before, ["token", "_step"], "left").select(
        "token", "_step", "id", "impact", (F.coalesce("_before", F.lit(0)) + F.floor(place / block)).cast("long").alias("block")
    )
    return numbered.groupBy("token", "_step", "block").agg(
        F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("impact", "id")), asc=False).alias("postings")
    ).drop("_step")


def best_posts(index: DataFrame, df: DataFrame, query: str, limit: int = 50, text: str = "text", id_: str = "post_id", seeds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(hits, blocks): the ``limit`` best posts with every query term, as ``posts`` finds them, and which blocks were read.

    The first ``seeds`` blocks of each term give posts whose ranks are worked out; the limit-th of these is a bar. A
    post at the bar has a term of at least an equal share of it, so it stands in a block whose largest impact reaches
    bar / terms: all other blocks are skipped, and only posts of the blocks read are looked up.
    """
    terms = query_terms(query)
    blocks = index.filter(F.col("token").isin(terms))
    # only posts that hold every term can have a rank
    for t in terms:
        df = df.filter(F.contains(F.lower(F.col(text)), F.lit(t)))

    def ranked(ids: DataFrame) -> DataFrame:
        some = df.join(ids.distinct(), id_, "left_semi")
        return some.withColumn("rank", _rank(F.col(text), terms)).filter("rank > 0")

    posted = lambda b: b.select(F.explode("postings").alias("p")).select(F.col("p.id").alias(id_), F.col("p.impact").alias("_impact"))
    first = ranked(posted(blocks.filter(F.col("block") < seeds)).select(id_)).orderBy(F.desc("rank"), id_).limit(limit)
    bar = first.agg(F.when(F.count(F.lit(1)) >= limit, F.min("rank")).alias("bar")).first()["bar"]  # one number
    share = 0.0 if bar is None else bar / len(terms) - 1e-12
    read = blocks.withColumn("read", F.col("top") >= share)
    found = ranked(posted(read.filter("read")).filter(F.col("_impact") >= share).select(id_))
    top = found.orderBy(F.desc("rank"), id_).limit(limit)
    return top.withColumn("snippet", snippet(F.col(text), terms)), read.select("token", "block", "top", "n", "read")


def nodes(vertices: DataFrame, query: str, labels: list[str], props: list[str], limit: int = 20) -> DataFrame:
    """Nodes of the searched labels ranked by hits over their searched properties."""
    terms = query_terms(query)
    joined = F.concat_ws(" ", *[F.col(p) for p in props])

    def any_rank(toks: Column) -> Column:
        total = sum((_hits(toks, w) for w in terms[1:]), _hits(toks, terms[0]))
        return total / (1.0 + F.ln(F.greatest(F.size(toks), F.lit(1)).cast("double")))

    scored = vertices.filter(F.col("label").isin(labels)).withColumn("score", bind(tokens(joined), any_rank))
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)
