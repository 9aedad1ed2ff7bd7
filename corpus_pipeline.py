"""A corpus made ready for training: five stages over ``documents``, each written and read again."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwire.lineage import cut_lineage
from duskwire.llm.containment import without_items
from duskwire.llm.ngram_join import ngram_components
from duskwire.llm.packing import packed
from duskwire.llm.pii import extracted, masked
from duskwire.llm.queries import VOCABULARY, rows
from duskwire.llm.toxicity import fit, scored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    weights = fit(docs, rows(spark, sf_dir, "labels"))
    return scored(docs, weights).filter("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id, and of repeated rows one."""
    first = ngram_components(docs).filter("doc_id <=> component_id").select("doc_id")
    kept = docs.alias("d").join(first.alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_items(docs, rows(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in place of personal data."""
    out = masked(docs, extracted(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packed(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: A learned classifier and a tokenizer are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
