"""Bands, labels and the likelihood-ratio adjustments."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import first_non_empty, lookup


def band(score: Column) -> Column:
    return (
        F.when(score >= 90, "VERY_HIGH")
        .when(score >= 75, "HIGH")
        .when(score >= 50, "MODERATE")
        .when(score >= 25, "LOW")
        .otherwise("WEAK")
    )


def severity(score: Column) -> Column:
    return (
        F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.4, "medium").otherwise("low")
    )


def letter_band(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").otherwise("C")


def kind_label(kind: Column) -> Column:
    return lookup(kind, fixed.KIND_LABELS, F.lit("Entity"))


def display_label(label: Column, value: Column, fingerprint: Column, address: Column, name: Column, id_: Column) -> Column:
    return first_non_empty(label, value, fingerprint, address, name, id_)


def why_text(evidence_type: Column) -> Column:
    return lookup(evidence_type, fixed.WHY_TEXTS, F.concat(F.lit("Evidence: "), evidence_type))


def default_ratio(evidence_type: Column) -> Column:
    return lookup(evidence_type, {k: v[0] for k, v in fixed.EVIDENCE_TYPES.items()}, F.lit(1.0))


def family(evidence_type: Column) -> Column:
    return lookup(evidence_type, {k: v[1] for k, v in fixed.EVIDENCE_TYPES.items()}, F.lit("handle"))


def description(evidence_type: Column) -> Column:
    return lookup(evidence_type, {k: v[2] for k, v in fixed.EVIDENCE_TYPES.items()}, evidence_type)


def adjusted_llr(ratio: Column, reliability: Column, credibility: Column) -> Column:
    """ln(ratio) discounted by source reliability and information credibility."""
    grade = lookup(reliability, fixed.RELIABILITY, F.lit(0.5))
    trust = lookup(credibility.cast("int"), fixed.CREDIBILITY, F.lit(0.5))
    return F.when(ratio <= 0, F.lit(0.0)).otherwise(F.ln(ratio) * grade * trust)


def normalize_group(name: Column) -> Column:
    """Canonical group name over the known aliases."""
    aliases = {c: c for c in fixed.GROUP_ALIASES}
    for canonical, names in fixed.GROUP_ALIASES.items():
        aliases.update({n: canonical for n in names})
    cleaned = F.translate(F.lower(F.trim(name)), "_-", "  ")
    return lookup(cleaned, aliases, cleaned)
