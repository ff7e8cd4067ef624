"""Confidentiality: labels, signals, the safe combination with a model's level, and who may read what."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules

RANK = {name: i for i, name in enumerate(rules.LEVELS)}


def level_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, rules.LEVELS)), rank + 1)


def explicit_label(text: Column) -> tuple[Column, Column]:
    """(level, words that say so) of the first label, in their order, that the text bears."""
    hit = lambda p: F.coalesce(text, F.lit("")).rlike(p)
    level = F.coalesce(*[F.when(hit(p), F.lit(name)) for p, name in rules.LEVEL_LABELS])
    words = F.coalesce(*[F.when(hit(p), F.regexp_extract(text, p, 0)) for p, _ in rules.LEVEL_LABELS])
    return level, words


def signals(text: Column) -> Column:
    """Names of the groups of sensitive words that the text holds."""
    found = [F.when(F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(name)) for name, (_, words) in rules.SIGNALS.items()]
    return F.array_compact(F.array(*found))


def signal_rank(found: Column) -> Column:
    """The highest rank that the signals imply; null without any."""
    return F.array_max(F.transform(found, lambda s: C.rank_of(s, {n: RANK[level] for n, (level, _) in rules.SIGNALS.items()})))


def classify(documents: DataFrame) -> DataFrame:
    """Adds explicit_level, explicit_evidence, signals and suggested_level to documents (text, document_type)."""
    level, words = explicit_label(F.col("text"))
    out = documents.withColumns({"explicit_level": level, "explicit_evidence": words, "signals": signals(F.col("text"))})
    prior = F.when(F.lower(F.trim("document_type")).isin(rules.NDA_TYPES), "confidential")
    return out.withColumn("suggested_level", F.coalesce("explicit_level", level_name(signal_rank(F.col("signals"))), prior))


def combine(rows: DataFrame) -> DataFrame:
    """Adds level, confidence, needs_confirmation, combination to classified rows with model_level, model_confidence, ocr_ratio.

    A label is never lowered; more than one level between rules and model asks for confirmation and
    caps confidence at 0.5; bad scans cap it at 0.4; nothing becomes public for want of signs.
    """
    model = F.coalesce("model_level", F.lit("internal"))
    sure = F.coalesce("model_confidence", F.lit(0.0))
    r = lambda c: C.rank_of(c, RANK, 1)
    labelled, suggested = F.col("explicit_level").isNotNull(), F.col("suggested_level").isNotNull()
    rank = F.when(labelled, F.greatest(r(F.col("explicit_level")), r(model))).when(suggested, F.greatest(r(F.col("suggested_level")), r(model))).otherwise(r(model))
    gap = ~labelled & suggested & (F.abs(r(F.col("suggested_level")) - r(model)) > 1)
    confidence = F.when(labelled, F.greatest(sure, F.lit(0.9))).when(gap, F.least(sure, F.lit(0.5))).otherwise(sure)
    ocr = F.coalesce("ocr_ratio", F.lit(0.0))
    confidence = F.when(ocr > 0.5, F.least(confidence, F.lit(0.4))).otherwise(confidence)
    out = rows.withColumns({
        "__rank": rank, "confidence": confidence, "needs_confirmation": gap | (ocr > 0.8),
        "combination": F.when(labelled, "explicit_label").when(suggested, "deterministic_plus_llm").otherwise("llm_only"),
    })
    silent = (F.col("__rank") == 0) & ((F.col("confidence") < 0.6) | ~suggested)
    return out.withColumns({
        "level": F.when(silent, "internal").otherwise(level_name(F.col("__rank"))),
        "needs_confirmation": F.col("needs_confirmation") | silent, "confidence": F.round("confidence", 3),
    }).drop("__rank")


def access_table(spark: SparkSession, access: dict[str, list[str]] = rules.ACCESS) -> DataFrame:
    return spark.createDataFrame([(level, role) for level, roles in access.items() for role in roles], "level string, role string")


def readable(documents: DataFrame, access: DataFrame, role: str) -> DataFrame:
    """The documents (confidentiality_level) that a role may read; unknown levels count as internal."""
    allowed = access.filter(F.col("role") == role).select(F.col("level").alias("__level"))
    level = F.when(F.col("confidentiality_level").isin(rules.LEVELS), F.col("confidentiality_level")).otherwise("internal")
    return documents.withColumn("__level", level).join(F.broadcast(allowed), "__level", "left_semi").drop("__level")  # at most a row a level
