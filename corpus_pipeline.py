"""The corpus pipeline: toxic documents go, then exact and near copies; what stays is mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; the next stage reads it back from Parquet. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of the given labels rejects go. Null texts are scored as empty ones; repeated rows alike."""
    from contractlake.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest id stays; null counts as empty."""
    from contractlake.llm import exact_dedup

    return exact_dedup.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; texts without words are linked with nothing and stay."""
    from contractlake.llm import near_dedup

    return near_dedup.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads any of it, in training order; what the mix does not reach is left out.

    Texts without words, which no mix can take, are left out too.
    """
    from contractlake.llm import mixing

    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, round_trip of each document; null and empty texts have no ids."""
    import public_tokenizers

    from contractlake.llm import sentence_pieces

    return sentence_pieces.encode_documents(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence pieces", encode),
]

#: No stage but the second can be said in SQL: the first needs its trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`, each written as Parquet and read again. An empty table gives an empty result."""
    from contractlake.llm.common import new_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
