"""Clauses as a log of deltas that readers merge: a batch writes only what came, compaction folds what lies there.

Under one root: `data/batch=N/kind=delta|base/bucket=B` holds Parquet files, `manifest/version=V` one JSON row that names the live
folders and the last batch. A version is there once Spark has committed it; folders that no manifest names are never read. Batches are
numbered upwards, as a stream's are: one at or below the last is a replay and changes nothing, and one that broke off is written anew.
There is one writer at a time; a second that commits the same version fails. Folders that compaction left behind are kept for readers
of older versions; their removal is left to the store's retention rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.operators import dedup

MANIFEST = "version long, last_batch long, folders array<struct<batch: long, kind: string>>"
KEY = ["document_id", "content_hash"]


class State(NamedTuple):
    version: int
    last_batch: int
    folders: list[tuple[int, str]]


def state(spark: SparkSession, root: str) -> State:
    """The newest manifest; a root without one is an empty table."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return State(-1, -1, [])
    row = found.orderBy(F.desc("version")).first()
    return State(-1, -1, []) if row is None else State(row["version"], row["last_batch"], [(f["batch"], f["kind"]) for f in row["folders"]])


def _commit(spark: SparkSession, root: str, new: State) -> None:
    row = spark.createDataFrame([(new.version, new.last_batch, new.folders)], MANIFEST)
    row.write.mode("errorifexists").json(f"{root}/manifest/version={new.version}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, batch: int, kind: str, buckets: int) -> None:
    """Rows by bucket; a bucket that is far larger than the others is written by several tasks."""
    placed = rows.withColumn("bucket", _bucket(F.col("document_id"), buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch}/kind={kind}")


def apply_batch(arrivals: DataFrame, root: str, batch: int, *, buckets: int = 64) -> bool:
    """Writes the arrivals (as dedup.upsert_clauses takes them) as the delta of `batch`; False if that batch is in the table already.

    An empty batch is recorded without a folder.
    """
    spark = arrivals.sparkSession
    now = state(spark, root)
    if batch <= now.last_batch:
        return False
    new = dedup.upsert_clauses(arrivals)
    folders = now.folders
    if not arrivals.isEmpty():
        _write(new, root, batch, "delta", buckets)
        folders = [*folders, (batch, "delta")]
    _commit(spark, root, State(now.version + 1, batch, folders))
    return True


def read(spark: SparkSession, root: str, documents: list | None = None, *, buckets: int = 64) -> DataFrame | None:
    """The merged clauses, as dedup.merge_clauses gives them after all batches; None if nothing was ever written.

    Ids are those of the first batch that had one, pages and confidences those of the last, versions add up. Null keys are a key of their
    own. With a short list of `documents`, only their buckets are read.
    """
    now = state(spark, root)
    if not now.folders:
        return None
    rows = spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/batch={b}/kind={k}" for b, k in now.folders])
    if documents is not None:
        kind = rows.schema["document_id"].dataType
        wanted = [F.lit(d).cast(kind) for d in documents]
        rows = rows.filter(F.col("document_id").isin(wanted) & F.col("bucket").isin([_bucket(w, buckets) for w in wanted]))
    known = lambda name: F.when(F.col(name).isNotNull(), F.col("batch"))
    return rows.groupBy(*KEY).agg(
        F.min_by("clause_id", known("clause_id")).alias("clause_id"),
        F.max_by("page_reference", known("page_reference")).alias("page_reference"),
        F.max_by("confidence", known("confidence")).alias("confidence"),
        F.sum("version").alias("version"),
    )


def compact(spark: SparkSession, root: str, *, least: int = 2, buckets: int = 64) -> bool:
    """Folds all live folders into one base, if there are `least` or more. Readers and later batches see the same rows."""
    now = state(spark, root)
    if len(now.folders) < max(least, 2):
        return False
    newest = max(b for b, _ in now.folders)
    _write(read(spark, root), root, newest, "base", buckets)
    _commit(spark, root, State(now.version + 1, now.last_batch, [(newest, "base")]))
    return True
