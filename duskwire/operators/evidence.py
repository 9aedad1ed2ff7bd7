"""Evidence scoring: likelihood ratios per pair, damped within families."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.columns import lookup


def adjust(evidence: DataFrame) -> DataFrame:
    """Adds family, effective ratio and adjusted log ratio to each evidence row.

    Needs: evidence_type, lr (NULL for the default of the type), reliability, credibility.
    """
    ratio = F.coalesce(F.col("lr"), scores.default_ratio(F.col("evidence_type")))
    return (
        evidence.withColumn("effective_lr", ratio)
        .withColumn("family", scores.family(F.col("evidence_type")))
        .withColumn("adjusted_llr", scores.adjusted_llr(F.col("effective_lr"), F.col("reliability"), F.col("credibility")))
    )


def by_family(adjusted: DataFrame, keys: list[str], more: Mapping[str, Column] | None = None) -> DataFrame:
    """Strongest item plus half of the others per (pair, family), then the cap of the family.

    max + 0.5 * (sum - max) needs no sorting, so partial aggregation applies. ``more``: further aggregates.
    """
    raw = adjusted.groupBy(*keys, "family").agg(
        (0.5 * F.sum("adjusted_llr") + 0.5 * F.max("adjusted_llr")).alias("raw_llr"),
        F.count(F.lit(1)).alias("items"),
        *[x.alias(name) for name, x in (more or {}).items()],
    )
    cap = lookup(F.col("family"), fixed.FAMILY_CAPS)
    return raw.withColumn("capped", F.coalesce(F.col("raw_llr") > cap, F.lit(False))).withColumn(
        "family_llr", F.least("raw_llr", cap)
    )


def score_column(total_llr, prior: float = fixed.PRIOR_ODDS):
    odds = F.lit(prior) * F.exp(total_llr)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100.0 * odds / (1.0 + odds), 1)))


def score_links(evidence: DataFrame, keys: list[str], prior: float = fixed.PRIOR_ODDS, summary: bool = False) -> DataFrame:
    """Score, band, family contributions, reasons and warnings per pair; with ``summary`` its evidence as well.

    Evidence is dealt by pair once; families and pairs are summed behind that one shuffle. A pair has a handful of
    evidence rows, so its reasons fit in one array.
    """
    adjusted = adjust(evidence).repartition(*keys)
    reason = F.struct((-F.round("adjusted_llr", 9)).alias("o"), scores.description(F.col("evidence_type")).alias("t"))
    item = F.struct(F.col("evidence_type").alias("type"), F.col("effective_lr").alias("lr"), "reliability", "credibility")
    lists = {"_why": reason, **({"_items": item} if summary else {})}
    families = by_family(adjusted, keys, {name: F.collect_list(x) for name, x in lists.items()})
    odds = F.lit(prior) * F.exp(F.sum("family_llr"))
    warning = F.when(
        F.col("capped"),
        F.concat(
            F.col("family"), F.lit(" evidence capped at "), F.format_number("family_llr", 2),
            F.lit(" (was "), F.format_number("raw_llr", 2), F.lit(") to prevent inflation"),
        ),
    )
    gathered = lambda name: F.array_sort(F.flatten(F.collect_list(name)))
    scored = families.groupBy(*keys).agg(
        score_column(F.sum("family_llr"), prior).alias("score"),
        (odds / (1.0 + odds)).alias("posterior"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "family_llr")))).alias("family_contributions"),
        F.array_sort(F.collect_list(warning)).alias("warnings"),
        F.transform(gathered("_why"), lambda e: e["t"]).alias("why"),
        *([gathered("_items").alias("evidence_summary")] if summary else []),
    )
    return scored.withColumn("band", scores.band(F.col("score"))).withColumn("analyst_status", F.lit("pending"))


def why(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Reasons per pair, strongest first; strengths equal to nine decimals go by text."""
    text = scores.description(F.col("evidence_type"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("adjusted_llr", 9)).alias("o"), text.alias("t"))))
    return adjusted.groupBy(*keys).agg(F.transform(ranked, lambda e: e["t"]).alias("why"))
