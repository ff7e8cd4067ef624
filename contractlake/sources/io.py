"""Sources and sinks: files, operational tables, logs, guards, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules
from contractlake.sources import schemas


def pages_of_lines(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Page rows from extracted text, one line a page: document, page_number (from 1), text, source, char_count."""
    rows = documents.select(F.col(key).alias("document"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "text"))
    return rows.select("document", (F.col("pos") + 1).alias("page_number"), "text", F.lit("text").alias("source"), F.length(C.strip(F.col("text"))).alias("char_count"))


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Page rows from raw text files, one a document, whose pages end with a form feed: as `pages_of_lines`, by the file's name without its suffix.

    Spark cuts the files into byte ranges at form feeds, so one long document is read by many tasks. Pages are numbered
    by an aggregate a range (document, range, pages) before them and their place in the range; texts are not shuffled by
    document. A last page needs no form feed; files without text have no pages; files of one name count as one document
    and must not share a path's last part.
    """
    raw = spark.read.option("lineSep", "\f").text(path)
    at = F.col("_metadata.file_block_start")
    name = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B")), r"\.[^.]*$", "")
    pages = raw.select(name.alias("document"), at.alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    ranges = pages.groupBy("document", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("pages"))
    w = W.partitionBy("document").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.select("document", "start", "first", F.coalesce(F.sum("pages").over(w), F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("id") - F.col("first") + 1).cast("int")
    rows = pages.join(before, ["document", "start"])
    return rows.select("document", number.alias("page_number"), "text", F.lit("text").alias("source"), F.length(C.strip(F.col("text"))).alias("char_count"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends records to a JSON-lines log."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def export_chunks(chunks: DataFrame, path: str, key: str = "document", buckets: int = 64) -> None:
    """Chunk metadata as JSON lines, in `buckets` folders by a hash of the document, whose chunks stay together and in order."""
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition(key).sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").json(path)


def reject_reason() -> Column:
    """The first upload rule that a manifest row (name, content_type, n_bytes, n_pages, question, comment) breaks; null if none."""
    extension = F.lower(F.substring_index("name", ".", -1))
    wrong = F.lit(True)
    for ext, types in rules.UPLOAD_TYPES.items():
        wrong = F.when(extension == ext, ~F.col("content_type").isin(types)).otherwise(wrong)
    return (
        F.when(~extension.isin(list(rules.UPLOAD_TYPES)) | ~F.contains("name", F.lit(".")), "unsupported extension")
        .when(F.col("content_type").isNotNull() & wrong, "content type mismatch")
        .when(F.coalesce("n_bytes", F.lit(0)) <= 0, "empty file")
        .when(F.col("n_bytes") > rules.MAX_UPLOAD_BYTES, "file too large")
        .when(F.col("n_pages") > rules.MAX_UPLOAD_PAGES, "too many pages")
        .when(F.length("question") > rules.MAX_QUESTION, "question too long")
        .when(F.length("comment") > rules.MAX_COMMENT, "comment too long")
    )


def upsert_vectors(stored: DataFrame, new: DataFrame, documents: DataFrame | None = None, *, key: str = "chunk_id", order: str = "load_seq") -> DataFrame:
    """Stored and new vectors, the last load of each id; document metadata (by `document`) is merged onto every chunk."""
    turn = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    rows = stored.unionByName(new, allowMissingColumns=True).withColumn("__turn", turn).filter("__turn = 1").drop("__turn")
    return rows if documents is None else rows.join(documents, "document", "left")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An operational table with its declared schema; columns that older files lack are null."""
    return spark.read.schema(schemas.TABLES[name]).option("mergeSchema", True).parquet(f"{root}/{name}")


def write_table(rows: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Writes the declared columns of a table, in their order and types."""
    from pyspark.sql.types import StructType

    declared = StructType.fromDDL(schemas.TABLES[name])
    present = set(rows.columns)
    cast = [(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    rows.select(*cast).write.mode(mode).parquet(f"{root}/{name}")


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, column: str | None = None, lower: int | None = None, upper: int | None = None, parts: int = 1, **options: str
) -> DataFrame:
    """A table of a database, in `parts` ranges of a numeric column if one is given; bounds left out come from the data.

    The bounds are a pushed aggregate, one row. Rows whose column is null are read with the first range. Filters and columns are pushed.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and parts > 1:
        if lower is None or upper is None:
            found = reader.load().agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
            lower, upper = (found["lo"] if lower is None else lower), (found["hi"] if upper is None else upper)
        if lower is not None and upper is not None and lower < upper:
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, *, mode: str = "overwrite", connections: int = 8, batch: int = 10_000, **options: str) -> None:
    """Rows into a table of a database over at most `connections` connections. An overwrite keeps the table's definition; run again, it gives the same rows."""
    writer = rows.write.format("jdbc").options(url=url, dbtable=table, numPartitions=connections, batchsize=batch, truncate="true", **options)
    writer.mode(mode).save()


def merge_edges(stored: DataFrame, new: DataFrame, keys: list[str], order: str = "load_seq") -> DataFrame:
    """Node or edge tables with merge-on-key: the last write of each key stays."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return stored.unionByName(new).withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def seed_if_absent(target: DataFrame, seeds: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """The target with those (seed, profile) rows whose natural key it lacks. Profiles are a reference list of a few rows."""
    wanted = seeds.crossJoin(F.broadcast(profiles)).select(*target.columns).dropDuplicates(keys)
    return target.unionByName(wanted.join(target.select(*keys), keys, "left_anti"))


def record_events(rows: DataFrame, root: str, kind: str) -> None:
    """Appends events of a fixed shape, partitioned by date."""
    from pyspark.sql.types import StructType

    declared = StructType.fromDDL(schemas.EVENTS[kind])
    time = "timestamp" if "timestamp" in declared.names else "created_at"
    shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in declared]).withColumn("date", F.to_date(time))
    shaped.write.mode("append").partitionBy("date").parquet(f"{root}/{kind}")
