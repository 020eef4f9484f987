"""Table access and lineage cuts shared by the corpus operators.

Operators cut lineage by writing tables to the shared folder that spark.checkpoint.dir names, so building an operator's
DataFrame runs jobs. Tables that no later plan reads are deleted at once; the last ones, which the returned DataFrame reads,
stay until `scratch` ends around the caller, or until the folder is cleaned.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that need a number of their own while a stage runs are numbered from FREE on.
FREE = 1 << 61
#: Rows of an Arrow batch while a table is staged: texts of whole documents make batches large enough.
RECORDS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_made: list[str] = []
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session of one machine (local master), as in tests, may leave it
    unset and gets a temporary one; a cluster must name a folder that all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _local[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='pixelstrata-')}"
    return at.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and any executor may be lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    _made.append(path)
    usual = spark.conf.get(RECORDS, "10000")
    spark.conf.set(RECORDS, str(min(int(usual), BATCH) if int(usual) > 0 else BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RECORDS, usual)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def drop_staged(*tables: DataFrame | None) -> None:
    """Deletes staged tables that no later plan reads, and lets Spark's cleaner find the shuffles of finished jobs."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            _delete(df.sparkSession, path)
            df.sparkSession._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at its end; results that read them must be written or collected before."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            _delete(spark, path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, staged; what make staged on its way is deleted."""
    before = set(_made)
    out = staged(make())
    for path in [p for p in _made if p not in before and p != out.staged_path]:
        _delete(spark, path)
    return out


def with_ids(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage over docs, a stage that carries all columns, in which equal doc_ids mean equal texts: rows with a null doc_id, and
    rows whose text is not the smallest of their doc_id's texts, are documents of their own, after all others, and
    have their own doc_id again in what it returns. Those rows are staged, so that their numbers hold."""
    own, kind = "pixelstrata_doc_id", docs.schema["doc_id"].dataType
    texts = docs.filter("doc_id is not null").groupBy("doc_id")
    clash = staged(
        texts.agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).filter("x < y")
        .select("doc_id", F.col("x").alias(f"{own}_text"))
    )
    rows = docs.withColumn(own, F.col("doc_id"))
    named, others = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    if not clash.isEmpty():
        judged = named.join(clash, "doc_id", "left").withColumn(f"{own}_other", F.coalesce(F.xxhash64("text") != F.col(f"{own}_text"), F.lit(False)))
        others = others.unionByName(judged.filter(f"{own}_other").select(*rows.columns))
        named = judged.filter(f"not {own}_other").select(*rows.columns)
    free = (F.monotonically_increasing_id() + F.lit(FREE)).cast(kind)
    out = stage(named.unionByName(staged(others.withColumn("doc_id", free))))
    return out.withColumn("doc_id", F.col(own)).drop(own)
