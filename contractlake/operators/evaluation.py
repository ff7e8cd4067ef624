"""Metrics of extraction, classification, retrieval, citations and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions import columns as C


def clause_scores(rows: DataFrame) -> DataFrame:
    """Adds clause_recall, missed, unexpected to rows (found, expected, scanned_without_ocr)."""
    recall = F.when(F.size("expected") == 0, 1.0).otherwise(F.size(F.array_intersect("found", "expected")) / F.size(F.array_distinct("expected")))
    return rows.withColumns({
        "clause_recall": F.when(~F.coalesce("scanned_without_ocr", F.lit(False)), recall),
        "missed": F.array_sort(F.array_except("expected", "found")), "unexpected": F.array_sort(F.array_except("found", "expected")),
    })


def risk_precision(found: Column, expected: Column) -> Column:
    """Share of the high risks found that were expected; with none found 1 if none was expected, else 0."""
    return F.when(F.size(found) > 0, F.size(F.array_intersect(found, expected)) / F.size(F.array_distinct(found))).otherwise(F.when(F.size(expected) == 0, 1.0).otherwise(0.0))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def confusion(rows: DataFrame) -> DataFrame:
    """actual, predicted, n."""
    return rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class of a confusion matrix."""
    actual = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    predicted = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    rows = actual.join(predicted, "label", "full_outer").na.fill(0, ["support", "hits", "claimed"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumns({"precision": zero(F.try_divide("hits", "claimed")), "recall": zero(F.try_divide("hits", "support"))})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.select("label", "precision", "recall", f1.alias("f1"), "support")


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Mean F1 over the classes with support."""
    return metrics.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))


def ranking_metrics(queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int, *, key: str = "chunk_id") -> DataFrame:
    """query_id, recall, precision, reciprocal_rank of ranked hits (query_id, key, rank) against relevant pairs (query_id, key)."""
    good = hits.filter(F.col("rank") <= k).join(relevant.select("query_id", key).distinct(), ["query_id", key])
    per = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.count_distinct(key).alias("wanted"))
    rows = queries.select("query_id").join(wanted, "query_id").join(per, "query_id", "left").na.fill(0, ["hits"])
    return rows.select(
        "query_id", (F.col("hits") / F.col("wanted")).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_ranking(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("reciprocal_rank").alias("mrr"))


def leakage(hits: DataFrame, chunks: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """Hits (tenant) whose chunk belongs to another tenant: number and rate."""
    rows = hits.join(chunks.select(key, F.col("tenant").alias("owner")), key)
    return rows.agg(F.count_if(F.col("tenant") != F.col("owner")).alias("leaks"), F.avg((F.col("tenant") != F.col("owner")).cast("double")).alias("leak_rate"))


def citation_scores(cases: DataFrame) -> DataFrame:
    """Adds has_citation, correctness, passed to answered cases (answer, citations).

    A citation is sound if it has at least three characters and does not just repeat the answer.
    """
    low = lambda c: F.lower(C.strip(c))
    given = F.coalesce("citations", F.array().cast("array<string>"))
    sound = F.filter(given, lambda c: c.isNotNull() & (F.length(C.strip(c)) >= 3) & (low(c) != low(F.col("answer"))))
    rows = cases.filter(F.coalesce("answer", F.lit("")) != "")
    rows = rows.withColumn("has_citation", F.size(given) > 0).withColumn("correctness", F.try_divide(F.size(sound), F.size(given)))
    return rows.withColumn("passed", F.col("has_citation") & F.coalesce(F.col("correctness") >= 0.5, F.lit(True)))


def citation_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.col("has_citation").cast("double")).alias("citation_recall"), F.avg("correctness").alias("citation_correctness"), F.count(F.lit(1)).alias("n_cases"))


def scorable(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases with an answer and contexts, the most recent `limit` of them (seq)."""
    rows = log.filter((F.coalesce("answer", F.lit("")) != "") & (F.size(F.coalesce("contexts", F.array().cast("array<string>"))) > 0))
    rows = rows.withColumn("reference_source", F.when(F.col("reference_answer").isNotNull(), "reference").otherwise("answer"))
    return rows if limit is None else rows.orderBy(F.desc("seq")).limit(limit)


def judge_means(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means of judge scores; null and NaN are left out."""
    return scores.agg(*[F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in columns])


def low_text_scores(rows: DataFrame) -> DataFrame:
    """Adds detection_recall, recovery_rate, passed to rows (expected_low, detected_low, recovered: arrays of page numbers)."""
    share = lambda a, b: F.when(F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    out = rows.withColumns({
        "detection_recall": share(F.col("detected_low"), F.col("expected_low")), "recovery_rate": share(F.col("recovered"), F.col("expected_low")),
    })
    return out.withColumn("passed", (F.col("detection_recall") == 1.0) & (F.col("recovery_rate") >= 0.5))


def low_text_rates(pages: DataFrame, expected: DataFrame, detected: DataFrame, recovered: DataFrame) -> DataFrame:
    """document, detection_recall, recovery_rate, passed: low_text_scores from page lists (document, page_number) in place of arrays.

    Each document of `pages` has a row; one without expected pages has shares of 1. Repeated pages count once, pages of other documents
    not at all. Flags are folded by page and then summed by document, so no document's pages are gathered.
    """
    lists = {"known": pages, "expected": expected, "detected": detected, "recovered": recovered}
    flags = [df.select("document", "page_number", *[F.lit(int(name == n)).alias(n) for n in lists]) for name, df in lists.items()]
    rows = flags[0]
    for more in flags[1:]:
        rows = rows.unionByName(more)
    page = rows.groupBy("document", "page_number").agg(*[F.max(n).alias(n) for n in lists])
    sums = page.groupBy("document").agg(
        F.max("known").alias("known"), F.sum("expected").alias("n"),
        F.sum(F.col("expected") * F.col("detected")).alias("found"), F.sum(F.col("expected") * F.col("recovered")).alias("back"),
    ).filter("known = 1")
    share = lambda c: F.when(F.col("n") == 0, 1.0).otherwise(F.col(c) / F.col("n"))
    out = sums.select("document", share("found").alias("detection_recall"), share("back").alias("recovery_rate"))
    return out.withColumn("passed", (F.col("detection_recall") == 1.0) & (F.col("recovery_rate") >= 0.5))


def conflict_scores(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_x, doc_y, found: whether each expected pair (doc_a, doc_b, clause_type), in either order, has a conflict of its type."""
    key = lambda df: df.select(F.least("doc_a", "doc_b").alias("doc_x"), F.greatest("doc_a", "doc_b").alias("doc_y"), "clause_type").distinct()
    found = key(pairs).withColumn("hit", F.lit(True))
    rows = key(expected).join(found, ["doc_x", "doc_y", "clause_type"], "left")
    return rows.groupBy("doc_x", "doc_y").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("found"))


def dedup_check(clauses: DataFrame) -> DataFrame:
    """Clauses and distinct contents by type."""
    hashed = clauses.withColumn("h", C.clause_hash(F.col("clause_type"), F.lit(""), F.col("text")))
    return hashed.groupBy("clause_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n_distinct"))


def run_results(domains: dict[str, DataFrame]) -> DataFrame:
    """domain, n_cases, n_passed, pass_rate over the case tables (case_label, passed) of those domains that ran."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(d).alias("domain"), "passed") for d, df in domains.items()])
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if("passed").alias("n_passed"), F.avg(F.col("passed").cast("double")).alias("pass_rate")
    )


def run_status(results: DataFrame) -> DataFrame:
    """completed, or failed where no domain ran."""
    return results.agg(F.when(F.count(F.lit(1)) > 0, "completed").otherwise("failed").alias("status"))
