"""Exact deduplication against immutable snapshots.

Texts are equal when their bytes are, after lower-casing A-Z only; null counts as empty. A snapshot
keeps one row a text (digest, bytes, id that stays, number of rows) in buckets by digest, and one
static binary-fuse filter a bucket. The digests of an incoming batch are first grouped among
themselves; each distinct one asks the filter of its bucket. Those that it denies are new. The
others are joined with the exact bucket, and the texts that share a digest are compared byte by
byte. One text of each group of the batch is compared, so copies cost nothing more.

The row with the largest doc_id stays; null ids stay only if no row of the text has one. Where rows
with equal text share that id, one of them stays. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.llm import fuse
from contractlake.llm.common import ascii_lower, stage

#: Distinct digests that a bucket is sized for; the number of buckets follows from the rows.
PER_BUCKET = 200_000
FILTER_SCHEMA = "bucket int, seed decimal(20,0), segment long, spread long, prints binary"


class Snapshot(NamedTuple):
    """`rows`: bucket, sha, n_bytes, keep_id, n_rows. `filters`: one row a bucket. `texts`: doc_id, text of the documents it was built from."""

    rows: DataFrame
    filters: DataFrame
    texts: DataFrame
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha (hex SHA-256 of the normalised text) and n_bytes of each row."""
    lowered = docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
    return lowered.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


def groups(rows: DataFrame) -> DataFrame:
    """One row a text: the id that stays and the number of rows; summed before the shuffle, so hot texts stay small."""
    return rows.groupBy("sha", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def _bucket(n: int):
    return F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def _keys(sha: pd.Series) -> np.ndarray:
    """The 64 bits of the digest that the filters take: not those that name the bucket."""
    return np.array([int(x[16:32], 16) for x in sha], dtype=np.uint64)


def build_snapshot(rows: DataFrame, texts: DataFrame, buckets: int) -> Snapshot:
    """The snapshot of `rows` (as from digests()), whose documents are in `texts`."""
    exact = stage(groups(rows).withColumn("bucket", _bucket(buckets)).repartition("bucket"), "dedup-snapshot")

    def filters(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(np.unique(_keys(part["sha"])))
        from decimal import Decimal

        return pd.DataFrame({"bucket": [key[0]], "seed": [Decimal(f.seed)], "segment": [f.segment], "spread": [f.spread], "prints": [f.prints.tobytes()]})

    made = exact.select("bucket", "sha").groupBy("bucket").applyInPandas(filters, FILTER_SCHEMA)
    return Snapshot(exact, stage(made, "dedup-filters"), texts, buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of `batch` (as from groups()) that the snapshot's filters let pass; the others are new for certain."""

    def ask(key: tuple, part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(filters):
            return part.iloc[:0]
        x = filters.iloc[0]
        f = fuse.Fuse(int(x["seed"]), int(x["segment"]), int(x["spread"]), np.frombuffer(x["prints"], np.uint16))
        return part[fuse.contains(f, _keys(part["sha"]))]

    keyed = batch.withColumn("bucket", _bucket(snapshot.buckets))
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(ask, keyed.schema)


def classes(batch_rows: DataFrame, texts: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One row a text of snapshot and batch: sha, n_bytes, from_batch (null: rows of both), keep_id, n_rows.

    `from_batch` is set only where equal digests hide different bytes.
    """
    batch = stage(groups(batch_rows), "dedup-batch")
    maybe = screen(batch, snapshot)
    old = snapshot.rows.select("sha", "n_bytes", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows"), "bucket")
    hits = stage(maybe.join(old, ["bucket", "sha", "n_bytes"]), "dedup-hits")
    same = _same_bytes(hits, texts, snapshot.texts)
    judged = batch.join(same, ["sha", "n_bytes"], "left")
    mine = judged.select(
        "sha", "n_bytes",
        F.when(F.col("equal") == F.lit(False), F.lit(True)).alias("from_batch"),
        "keep_id", "n_rows",
    )
    theirs = snapshot.rows.join(same, ["sha", "n_bytes"], "left").select(
        "sha", "n_bytes", F.when(F.col("equal") == F.lit(False), F.lit(False)).alias("from_batch"), "keep_id", "n_rows"
    )
    return mine.unionByName(theirs).groupBy("sha", "n_bytes", "from_batch").agg(F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))


def _same_bytes(hits: DataFrame, texts: DataFrame, old_texts: DataFrame) -> DataFrame:
    """sha, n_bytes, equal: whether the texts of both sides have the same bytes. Joined on the rows that stand for the groups, one a side."""
    row_key = F.concat_ws("|", "sha", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def bytes_of(source: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        lowered = source.select("doc_id", ascii_lower(F.col("text")).alias("text"))
        keyed = lowered.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).select(row_key.alias("row_key"), "sha", F.col("text").alias(name))
        key = wanted.select(row_key.alias("row_key"))
        return keyed.join(key, "row_key", "left_semi").dropDuplicates(["row_key"]).drop("row_key")

    new = bytes_of(texts, hits.select("sha", F.col("keep_id").alias("doc_id")), "new_text")
    old = bytes_of(old_texts, hits.select("sha", F.col("old_id").alias("doc_id")), "old_text")
    both = hits.select("sha", "n_bytes").join(new, "sha").join(old, "sha")
    return both.select("sha", "n_bytes", (F.col("new_text") == F.col("old_text")).alias("equal"))


def dedup(docs: DataFrame) -> DataFrame:
    """All rows of `docs` (doc_id, text), taken as two batches by a hash of the id: the first becomes a snapshot, the second is held against it.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.
    """
    half = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2)) == 0
    rows = stage(digests(docs).withColumn("first", half), "dedup-digests")
    buckets = max(1, -(-rows.count() // PER_BUCKET))
    snapshot = build_snapshot(rows.filter("first"), docs.filter(half), buckets)
    found = stage(classes(rows.filter("not first"), docs.filter(~half), snapshot), "dedup-classes")
    apart = not found.filter("from_batch is not null").isEmpty()
    on = (rows["sha"] == found["sha"]) & (rows["n_bytes"] == found["n_bytes"])
    if apart:
        on &= F.coalesce(found["from_batch"], ~rows["first"]) == ~rows["first"]
    joined = rows.join(found, on).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), rows["sha"].alias("text_sha256"), rows["n_bytes"],
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )
    # Rows that share both text and id are alike in every column but `kept`: count them, and keep one.
    if rows.groupBy("sha", "doc_id").count().filter("count > 1").isEmpty():
        return joined
    turn = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy("n_bytes"))
    return joined.withColumn("kept", F.col("kept") & (turn == 1))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    decided = dedup(docs.select("doc_id", "text")).filter("kept").select(
        F.concat_ws("|", "text_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__keep_key")
    )
    sha = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    keyed = docs.withColumn("__keep_key", F.concat_ws("|", sha, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    out = keyed.join(decided, "__keep_key", "left_semi").dropDuplicates(["__keep_key"])
    return out.select(*docs.columns)
