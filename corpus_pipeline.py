"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. The last emits each document once for each of its copies in the mix, numbered in `copy`. Rows
without a doc_id, and further texts of a repeated doc_id, are judged like the rest, each as a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelstrata.llm.decontaminate import decontaminated
from pixelstrata.llm.mixing import mixed
from pixelstrata.llm.near_dup import without_copies
from pixelstrata.llm.quality import selected, trained
from pixelstrata.llm.substring_dedup import without_repeats
from pixelstrata.llm.tables import drop_staged, staged_alone, table, with_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model puts in the highest grade; the others go."""
    return selected(docs, trained(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return with_ids(docs, without_copies)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller document has."""
    return with_ids(docs, without_repeats)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return with_ids(docs, lambda rows: decontaminated(rows, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights."""
    return mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", leaks),
    ("mixing to target weights", mix),
]

#: No SQL states a trained model's rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next. What the last one reads stays
    there; the rest is deleted on the way."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = staged_alone(spark, lambda rows=docs, step=stage: step(spark, rows, sf_dir))
        drop_staged(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
