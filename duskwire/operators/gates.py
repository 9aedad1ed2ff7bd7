"""Policy, safety, retention, redaction and URL gates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, pages
from ..functions.columns import bind
from ..functions.hashing import name_uuid


def base_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def policy(refs: DataFrame, sources: DataFrame, denylist: DataFrame | None = None) -> DataFrame:
    """One decision row per candidate; the first failing rule blocks it.

    ``refs``: source_id, url, content_type, size_bytes. ``sources``: the registry.
    ``denylist``: optional column ``host``. A blocked row keeps its decision and has no
    event id; a candidate of a source that is not registered is blocked as ``unknown_source``.
    """
    known = sources.withColumn("_known", F.lit(True))
    joined = refs.join(known, "source_id", "left")
    joined = joined.withColumn("_type", base_type(F.col("content_type"))).withColumn("_host", pages.host(F.col("url")))
    if denylist is not None:
        denied = denylist.select(F.lower("host").alias("_host"), F.lit(True).alias("_denied")).distinct()
        joined = joined.join(denied, "_host", "left")
    else:
        joined = joined.withColumn("_denied", F.lit(None).cast("boolean"))
    status = F.col("authorization_status")
    rule = (
        F.when(F.col("_known").isNull(), "unknown_source")
        .when(~F.coalesce(F.col("enabled"), F.lit(False)), "source_disabled")
        .when(~F.coalesce(status.isin("approved", "authorized"), F.lit(False)), "unauthorized")
        .when((status == "authorized") & (F.coalesce(F.col("authorization_ref"), F.lit("")) == ""), "missing_auth_ref")
        .when(~F.coalesce(F.col("_type").isin(fixed.ALLOWED_CONTENT_TYPES), F.lit(False)), "content_type_blocked")
        .when(F.col("size_bytes") > fixed.MAX_CONTENT_BYTES, "size_exceeded")
        .when(F.col("_denied"), "domain_denied")
        .when(F.coalesce(F.col("retention_days"), F.lit(0)) <= 0, "no_retention")
    )
    decided = joined.withColumn("rule_hit", rule)
    redacts = F.coalesce(F.contains(F.lower("pii_policy"), F.lit("redact")), F.lit(False))
    return decided.withColumn(
        "decision",
        F.when(F.col("rule_hit").isNotNull(), "block").when(redacts, "redact_allow").otherwise("allow"),
    ).withColumn(
        "event_id",
        F.when(F.col("rule_hit").isNull(), name_uuid(F.concat_ws("|", F.lit("event"), "source_id", "url"))),
    ).drop("_type", "_host", "_denied", "_known")


def mime_allowed(content_type: Column) -> Column:
    """False for media, archives and executables, judged by the type alone."""
    pattern = "^(?:" + "|".join(p.replace(".", r"\.") for p in fixed.BLOCKED_MIME_PREFIXES) + ")"
    return ~base_type(content_type).rlike(pattern)


def content_allowed(text: Column) -> Column:
    """False if one of the prohibited patterns occurs anywhere in the text."""

    def clean(low: Column) -> Column:
        hit = F.lit(False)
        for pattern, word in fixed.PROHIBITED_PATTERNS:
            # the plain word is a cheap necessary condition
            hit = hit | (F.contains(low, F.lit(word)) & low.rlike(pattern))
        return ~hit

    return bind(F.lower(text), clean)


def retained(events: DataFrame, sources: DataFrame, at: Column) -> DataFrame:
    """Events that are still within the retention period of their source."""
    days = sources.select("source_id", "retention_days")
    kept = events.join(days, "source_id")
    age = F.unix_seconds(at) - F.unix_seconds("observed_at")
    return kept.filter(age <= F.col("retention_days").cast("long") * 86_400).drop("retention_days")


def _apply_rule(state: Column, digits: Column, name: str, pattern: str, replacement: str) -> Column:
    regex = F.lit(pattern)

    def step(s: Column) -> Column:
        # a cheap necessary condition first: three digits in a row, or an @
        text = s["text"]
        marked = F.contains(text, F.lit("@")) if name == "victim_email" else digits
        count = F.when(marked, F.regexp_count(text, regex)).otherwise(0)
        return bind(count, lambda c: F.struct(
            F.when(c > 0, F.regexp_replace(text, regex, F.lit(replacement))).otherwise(text).alias("text"),
            F.when(c > 0, F.concat(s["found"], F.array(F.concat(F.lit(f"{name}:"), c.cast("string")))))
            .otherwise(s["found"]).alias("found"),
        ))

    return bind(state, step)


def redacted(text: Column) -> Column:
    """``STRUCT<text, found>``: redacted text and counts such as ``phone:2``.

    Rules run one after the other on the text that the rule before left behind. Each stage is
    bound once, so the expression stays small however often a plan repeats it.
    """

    def run(digits: Column) -> Column:
        state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))
        for rule in fixed.REDACTION_RULES:
            state = _apply_rule(state, digits, *rule)
        return state

    # no rule makes digits, so the whole text is looked through for them once
    return bind(text.rlike(r"\p{Nd}{3}"), run)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace personal data in ``text``; adds ``redactions``."""
    return (
        df.withColumn("_r", redacted(F.col(text)))
        .withColumns({text: F.col("_r.text"), "redactions": F.col("_r.found")})
        .drop("_r")
    )


def enabled_sources(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    out = sources.filter(F.col("enabled") & F.col("authorization_status").isin("approved", "authorized"))
    return out.filter(F.col("source_type") == source_type) if source_type else out


def watch_match(domains: Column, patterns: Sequence[str] = tuple(fixed.WATCH_PATTERNS)) -> Column:
    """First pattern found in the first domain that matches any; NULL if none does."""

    def of_domain(d: Column) -> Column:
        out = None
        for p in patterns:
            hit = F.contains(F.lower(d), F.lit(p))
            out = F.when(hit, p) if out is None else out.when(hit, p)
        return out if out is not None else F.lit(None).cast("string")

    return F.get(F.filter(F.transform(domains, of_domain), lambda p: p.isNotNull()), F.lit(0))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """Disallowed path prefixes per domain that bind ``agent``.

    ``robots``: domain, text. A rule binds us if the last agent line above it is ``*`` or names us.
    """
    lines = F.transform(F.split("text", "\n"), lambda l: F.lower(F.btrim(l, F.lit(" \t\r\n"))))

    def value(line: Column) -> Column:
        return F.trim(F.regexp_replace(line, F.lit("^[^:]*:"), F.lit("")))

    def step(state: Column, line: Column) -> Column:
        is_agent = F.startswith(line, F.lit("user-agent:"))
        bound = F.when(
            is_agent, (value(line) == "*") | F.contains(value(line), F.lit(agent.lower()))
        ).otherwise(state["bound"])
        is_rule = F.startswith(line, F.lit("disallow:")) & state["bound"] & (value(line) != "")
        rules = F.when(is_rule, F.concat(state["rules"], F.array(value(line)))).otherwise(state["rules"])
        return F.struct(bound.alias("bound"), rules.alias("rules"))

    start = F.struct(F.lit(False).alias("bound"), F.array().cast("array<string>").alias("rules"))
    walked = F.aggregate(lines, start, step, lambda s: s["rules"])
    return robots.select("domain", F.explode(walked).alias("prefix"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs whose path starts with none of the prefixes of their domain.

    A path of n segments is looked up under each of its prefixes, so the test stays an equi join
    even for a domain with very many rules.
    """
    keyed = urls.withColumn("_domain", pages.host(F.col("url"))).withColumn(
        "_path", F.when(pages.path(F.col("url")) == "", "/").otherwise(pages.path(F.col("url")))
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("_path")), lambda i: F.substring(F.col("_path"), F.lit(1), i)
    )
    hits = (
        keyed.select("url", "_domain", F.explode(prefixes).alias("_prefix"))
        .join(rules.select(F.col("domain").alias("_domain"), F.col("prefix").alias("_prefix")), ["_domain", "_prefix"], "left_semi")
        .select("url")
        .distinct()
    )
    return keyed.drop("_domain", "_path").join(hits, "url", "left_anti")


def allowed_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(pages.allowed_target(F.col(url)))


