"""Dashboard counts, collection runs, source health, activity and evaluation metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import neighbours, running_sums


def kinds(entities: DataFrame) -> DataFrame:
    """Count per kind and the total (kind NULL)."""
    return entities.rollup("kind").agg(F.count(F.lit(1)).alias("n"))


def run_history(runs: DataFrame) -> DataFrame:
    """Collection runs with run number, cumulative items and status per source.

    ``runs``: source, run_at, run_id, items. A source with very many runs is split into ranges.
    """
    out = running_sums(
        runs, ["source"], ["run_at", "run_id"],
        {"run_count": F.lit(1).cast("long"), "cumulative_items": F.col("items").cast("long")},
    )
    return out.withColumn("status", F.when(F.col("items") > 0, "success").otherwise("empty"))


def source_summary(runs: DataFrame) -> DataFrame:
    """Latest run, run count and cumulative items per source; one aggregate, no window."""
    return runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.sum("items").alias("cumulative_items"),
        F.max("run_at").alias("completed_at"),
        F.max_by("items", F.struct("run_at", "run_id")).alias("total_items"),
    ).withColumn("status", F.when(F.col("total_items") > 0, "success").otherwise("empty"))


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_sources_run"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items_collected"),
    )


def daily_events(events: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Events per day for the last ``days`` days, zeros included."""
    spark = events.sparkSession
    first = F.date_sub(last_day, days - 1)
    calendar = spark.range(1).select(F.explode(F.sequence(first, last_day)).alias("day"))
    counted = (
        events.withColumn("day", F.to_date("observed_at"))
        .filter(F.col("day").between(first, last_day))
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    )
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def source_health(requests: DataFrame) -> DataFrame:
    """State per source from a request log: source_id, at, seq, ok, http_status.

    Failures since the last success need the time of that success and one more aggregate.
    """
    stamp = F.struct("at", "seq")
    totals = requests.groupBy("source_id").agg(
        F.max(F.when(F.col("ok"), stamp)).alias("_last_ok"),
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("ok").alias("total_successes"),
        F.count_if(~F.col("ok")).alias("total_failures"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"),
        F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure"),
    )
    failed = requests.filter(~F.col("ok")).join(totals.select("source_id", "_last_ok"), "source_id")
    recent = failed.filter(F.col("_last_ok").isNull() | (stamp > F.col("_last_ok")))
    streak = recent.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("consecutive_failures"),
        F.count_if(F.col("http_status") == 429).alias("consecutive_429s"),
    )
    joined = totals.drop("_last_ok").join(streak, "source_id", "left").fillna(
        0, ["consecutive_failures", "consecutive_429s"]
    )
    fails, limited = F.col("consecutive_failures"), F.col("consecutive_429s")
    backoff = (
        F.when(limited > 0, F.least(F.pow(F.lit(2.0), F.least(limited, F.lit(30))) * 60, F.lit(3600.0)))
        .when(fails > 0, F.least(F.pow(F.lit(2.0), F.least(fails, F.lit(30))) * 10, F.lit(600.0)))
        .otherwise(0.0)
    )
    status = F.when(fails >= 5, "offline").when(fails > 0, "degraded").otherwise("online")
    return joined.withColumn("status", status).withColumn("backoff_seconds", backoff)


def entity_totals(pages: DataFrame, struct_col: str = "entities") -> DataFrame:
    """Number of identifiers found per list name over all pages."""
    names = pages.schema[struct_col].dataType.fieldNames()
    sums = pages.agg(*[F.coalesce(F.sum(F.size(f"{struct_col}.{n}")), F.lit(0)).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("entity_type"), F.col(n).alias("n")) for n in names])
    return sums.select(F.explode(pairs).alias("p")).select("p.*").filter("n > 0")


def activity_profile(posts: DataFrame, actor: str = "actor_id", at: str = "posted_at") -> DataFrame:
    """24 hour bins and 7 weekday bins (1 = Sunday) per actor."""
    hours = [F.count_if(F.hour(at) == h).alias(f"h{h:02d}") for h in range(24)]
    days = [F.count_if(F.dayofweek(at) == d).alias(f"d{d}") for d in range(1, 8)]
    return posts.groupBy(actor).agg(*hours, *days)


def posting_gaps(posts: DataFrame, actor: str = "actor_id", at: str = "posted_at", id_: str = "post_id") -> DataFrame:
    """Each post with the seconds since the previous and until the next post of its actor."""
    timed = posts.select(actor, id_, at, F.unix_seconds(at).alias("_s"))
    return neighbours(timed, [actor], [at, id_], "_s").select(
        actor, id_, at, (F.col("_s") - F.col("prev")).alias("gap_before"), (F.col("next") - F.col("_s")).alias("gap_after")
    )


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, equal error rate and counts.

    Rows fold to one per distinct score; running sums over the scores give the rank sum
    with ties at half and both error rates per threshold.
    """
    per_score = scored.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    running = running_sums(per_score, [], [score], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})
    totals = per_score.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).withColumn("_one", F.lit(1))
    joined = running.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one")
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + 0.5 * F.col("neg"))
    # at threshold "score and above": misses are positives below, false links negatives at or above
    miss = (F.col("pos_upto") - F.col("pos")) / F.col("n_pos")
    false_link = (F.col("n_neg") - F.col("neg_upto") + F.col("neg")) / F.col("n_neg")
    return joined.agg(
        (F.sum(won) / (F.first("n_pos") * F.first("n_neg"))).alias("auc"),
        F.min_by((miss + false_link) / 2.0, F.struct(F.abs(miss - false_link), F.col(score))).alias("eer"),
        F.first("n_pos").alias("n_pos"),
        F.first("n_neg").alias("n_neg"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def evaluate_extraction(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Per kind: found and missed identifiers.

    ``truth``: actor_id, kind, normalized, in_text. ``hits``: actor_id, kind, normalized.
    An identifier that occurs in no text counts as neither.
    """
    found = hits.select("actor_id", "kind", "normalized").distinct().withColumn("_hit", F.lit(True))
    joined = truth.join(found, ["actor_id", "kind", "normalized"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    counts = joined.groupBy("kind").agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit & F.col("in_text")).alias("fn")
    ).withColumn("fp", F.lit(0).cast("long"))
    return counts.select("kind", "tp", "fp", "fn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def evaluate_pairs(truth: DataFrame, scored: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Per difficulty: hits, false links, misses, mean score.

    ``truth``: old_id, new_id, difficulty ('decoy' for pairs that must not link).
    """
    joined = truth.join(scored.select("old_id", "new_id", "score"), ["old_id", "new_id"], "left")
    linked = F.coalesce(F.col("score") >= threshold, F.lit(False))
    decoy = F.col("difficulty") == "decoy"
    counts = joined.groupBy("difficulty").agg(
        F.count_if(~decoy & linked).alias("tp"),
        F.count_if(decoy & linked).alias("fp"),
        F.count_if(~decoy & ~linked).alias("fn"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
    )
    return counts.select("difficulty", "tp", "fp", "fn", "avg_score", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))
