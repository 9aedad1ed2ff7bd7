"""Clock-skew profiles and the band join between them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import host
from . import intervals
from .ordering import newest_per_key


def recent_samples(probes: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` samples per URL. ``probes``: url, probed_at, clock_skew."""
    return newest_per_key(probes, ["url"], [F.desc("probed_at"), F.desc("clock_skew")], n)


def skew_profiles(probes: DataFrame, n: int = 20, min_samples: int = 3) -> DataFrame:
    """Mean and spread of the last samples of each URL with enough of them."""
    return (
        recent_samples(probes, n)
        .groupBy("url")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg("clock_skew").alias("avg_skew"),
            (F.max("clock_skew") - F.min("clock_skew")).alias("spread"),
        )
        .filter(F.col("samples") >= min_samples)
    )


def skew_pairs(profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """URL pairs whose mean skew differs by at most ``threshold`` seconds.

    A sorted interval join: half of all URLs may have one skew.
    """
    side = lambda x: profiles.select(
        F.col("url").alias(f"url_{x}"), F.col("avg_skew").alias(f"avg_{x}"), F.col("spread").alias(f"spread_{x}"), F.col("samples").alias(f"samples_{x}")
    )
    a, b = side("a"), side("b")
    # a little wider than the threshold; the difference itself decides below
    reach = threshold * (1.0 + 1e-9)
    met = intervals.within(b, a, F.col("avg_b"), F.col("avg_a") - reach, F.col("avg_a") + reach, "url_b", "url_a").filter("url_a < url_b")
    diff = F.abs(F.col("avg_a") - F.col("avg_b"))
    pairs = met.filter(diff <= threshold)

    def steadiness(spread: str):
        return 1.0 - F.least(F.col(spread), F.lit(5.0)) / 5.0

    confidence = F.least(
        F.lit(1.0),
        (1.0 - diff / threshold) * steadiness("spread_a") * steadiness("spread_b")
        * F.least(F.least("samples_a", "samples_b") / 10.0, F.lit(1.0)),
    )
    return pairs.select(
        "url_a", "url_b",
        F.bround("avg_a", 3).alias("skew_a_avg"),
        F.bround("avg_b", 3).alias("skew_b_avg"),
        F.bround(diff, 3).alias("skew_diff"),
        "samples_a", "samples_b",
        F.bround(confidence, 4).alias("confidence"),
    )


def skew_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """SHARES_CLOCK_SKEW edges between the first nodes that carry the hosts of both URLs.

    ``nodes``: id, host.
    """
    first = nodes.groupBy("host").agg(F.min("id").alias("id"))
    a = first.select(F.col("host").alias("_ha"), F.col("id").alias("src"))
    b = first.select(F.col("host").alias("_hb"), F.col("id").alias("dst"))
    keyed = pairs.withColumn("_ha", host(F.col("url_a"))).withColumn("_hb", host(F.col("url_b")))
    return keyed.join(a, "_ha").join(b, "_hb").select(
        "src", "dst", F.lit("SHARES_CLOCK_SKEW").alias("type"), "confidence", "skew_diff", "samples_a", "samples_b"
    )
