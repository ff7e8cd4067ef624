"""Batch retrieval: a table of queries against a table of chunks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.operators import nearest, search_index
from contractlake.session import shared_path, staged


def metadata_filter(*, contract_type: str | None = None, country: str | None = None, effective_from: int | None = None,
                    effective_to: int | None = None, least_value: float | None = None, most_value: float | None = None) -> Column:
    """Conjunction of the given conditions on flat metadata; null never matches a range."""
    cond = F.lit(True)
    if contract_type is not None:
        cond &= F.col("contract_type") == contract_type
    if country is not None:
        cond &= F.col("governing_law_country") == country.upper()
    for column, least, most in (("effective_epoch", effective_from, effective_to), ("monetary_value", least_value, most_value)):
        if least is not None:
            cond &= F.col(column) >= least
        if most is not None:
            cond &= F.col(column) <= most
    return cond


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, term, tf. Terms are counted within each task before the shuffle."""
    return chunks.select(key, F.explode(C.tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(chunks: DataFrame, key: str = "chunk_id", epsilon: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, idf by term, length by chunk). Negative idf becomes `epsilon` times the mean idf; chunks without a term count as empty."""
    p = postings(chunks, key)
    lengths = chunks.select(key, F.size(C.tokens(F.col("text"))).alias("dl"))
    n = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row
    raw = raw.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return p, idf, lengths.crossJoin(F.broadcast(n.select("avgdl")))


def bm25_scores(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], *, key: str = "chunk_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, key, score of each pair that shares a term; repeated query terms count as often as they occur."""
    p, idf, lengths = index
    asked = queries.select("query_id", F.explode(C.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # Terms of the queries reach the postings before these meet their lengths: only postings asked for go on.
    hits = p.join(asked.join(idf, "term"), "term").join(lengths, key)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, *, key: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """The k best of each query, with `rank` from 1; ties go to the smaller key. Spark keeps only k a query and task before the shuffle."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    ranked = scores.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)


def sparse_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, *, where: Column | None = None, key: str = "chunk_id", digits: int | None = None,
                 zero_rows: bool = False, index: search_index.Index | None = None) -> DataFrame:
    """BM25 top k over the chunks that pass `where`; with `zero_rows`, chunks without a shared term count 0 and fill up, by key.

    `index`: the stored index of just these chunks; where there is none, one is built in the shared folder.
    """
    if index is None:
        kept = chunks if where is None else chunks.filter(where)
        index = search_index.build(kept.select(key, "text"), shared_path(chunks.sparkSession, "search-index"), key=key)
    return search_index.search(queries, index, k, digits=digits, zero_rows=zero_rows)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, *, where: Column | None = None, key: str = "chunk_id", on: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Cosine top k of queries (query_id, query_vector) among chunks (key, embedding).

    `on` holds columns that must agree (tenant, say): an equi-join with column expressions. Without
    any, blocks of vectors are multiplied.
    """
    if not on:
        return blocked_top_k(queries, chunks, k, where=where, key=key, digits=9 if digits is None else digits)
    kept = (chunks if where is None else chunks.filter(where)).withColumn("norm_b", C.norm(F.col("embedding")))
    asked = queries.withColumn("norm_a", C.norm(F.col("query_vector")))
    score = C.cosine(F.col("query_vector"), F.col("embedding"), F.col("norm_a"), F.col("norm_b"))
    return top_k(asked.join(kept, on).select("query_id", key, score.alias("score")), k, key=key, digits=digits)


def blocked_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, *, where: Column | None = None, key: str = "chunk_id", least: float | None = None,
                  exclude: str | None = None, block: int = nearest.BLOCK, digits: int = 9, pivots: int = nearest.PIVOTS) -> DataFrame:
    """Cosine top k, exact, in matrix products of blocks that the triangle bound can't rule out; ties go to the smaller id.

    `exclude` names a column of both sides: pairs that agree on it are left out, as are pairs of one id. Ids are numbers.
    """
    kept = chunks if where is None else chunks.filter(where)
    group = (F.col(exclude) if exclude else F.lit(None)).cast("long").alias("g")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("query_vector").alias("v"), group)
    vectors = kept.select(F.col(key).cast("long").alias("id"), F.col("embedding").alias("v"), group)
    found = nearest.nearest(asked, vectors, k, least=least, apart=exclude is not None, block=block, digits=digits, pivots=pivots)
    return found.select("query_id", F.col("found").alias(key), "score", "rank")


def containing(passages: DataFrame, texts: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """query_id, key of the texts that hold the passage (query_id, query), wherever it begins.

    Words of a passage other than its first and last stand between blanks, so a text that holds it holds them as words: the hash of the first up to three
    of them meets the hashes of the text's runs of as many words in an equi-join, and only what matches is compared. Passages of fewer than three
    words have no such word and are compared with every text.
    """
    split = lambda c: F.split(c, r"[\x20\x09-\x0D]+")

    def print_of(words: Column, i: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *(F.get(words, i + j) for j in range(n)))

    def prints_of(words: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: print_of(words, i, n))

    def prints(n: int) -> DataFrame:
        """key, print: each run of n words of a text."""
        long = texts.select(key, split("text").alias("w")).filter(F.size("w") >= n)
        return long.select(key, F.explode(F.array_distinct(prints_of(F.col("w"), n))).alias("print"))

    asked = passages.select("query_id", "query", split("query").alias("w")).withColumn("inner", F.least(F.size("w") - 2, F.lit(3)))
    found = []
    for n in (r["inner"] for r in asked.filter("inner > 0").select("inner").distinct().collect()):  # 1, 2 or 3
        wanted = asked.filter(F.col("inner") == n).select("query_id", print_of(F.col("w"), F.lit(1), n).alias("print"))
        pairs = prints(n).join(wanted, "print").select("query_id", key).distinct()
        found.append(pairs.join(passages.select("query_id", "query"), "query_id").join(texts.select(key, "text"), key).filter(F.contains("text", F.col("query"))))
    short = asked.filter("inner <= 0").select("query_id", "query")
    if not found or not short.isEmpty():
        found.append(texts.select(key, "text").join(short, F.contains("text", F.col("query"))))
    out = [x.select("query_id", key) for x in found]
    return functools.reduce(DataFrame.unionByName, out)


def min_max(scores: DataFrame, column: str = "score", *, reverse: bool = False) -> DataFrame:
    """Adds `normal`: the score between 0 and 1 within its query; 1 where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    share = F.try_divide(F.col(column) - low, high - low)
    return scores.withColumn("normal", F.when(high == low, 1.0).otherwise(1 - share if reverse else share))


def fuse_convex(dense: DataFrame, sparse: DataFrame, alpha: float | Column = 0.4, *, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score: alpha * dense + (1 - alpha) * sparse of the normalised scores; a missing side counts 0."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    d = min_max(dense).select("query_id", key, F.col("normal").alias("dense"))
    s = min_max(sparse).select("query_id", key, F.col("normal").alias("sparse"))
    both = d.join(s, ["query_id", key], "full_outer")
    score = a * F.coalesce("dense", F.lit(0.0)) + (1 - a) * F.coalesce("sparse", F.lit(0.0))
    return both.select("query_id", key, score.alias("score"))


def fuse_ranks(lists: list[DataFrame], *, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """query_id, key, score: sum of 1 / (k + rank) over the ranked lists."""
    rows = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", key, "rank"))
    return rows.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def party_filter(hits: DataFrame, needle: str | Column) -> DataFrame:
    """Hits whose parties hold the needle, whatever the case."""
    wanted = F.lit(needle) if isinstance(needle, str) else needle
    return hits.filter(F.contains(F.lower("parties"), F.lower(wanted)))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds: the scorer used where none is given."""
    terms = F.array_distinct(C.tokens(query))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, C.tokens(text))) / F.size(terms))


def rerank(candidates: DataFrame, k: int, *, score: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """The k best candidates (query_id, query, key, text) by a pair score."""
    scored = candidates.withColumn("score", score if score is not None else overlap_score(F.col("query"), F.col("text")))
    return top_k(scored, k, key=key)


def candidate_lists(queries: DataFrame, chunks: DataFrame, k: int, *, key: str = "chunk_id", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The k best by cosine and by BM25. Both sides are read many times: give them as written tables, not as joins."""
    return blocked_top_k(queries, chunks, k, key=key), sparse_top_k(queries, chunks, k, key=key, digits=digits, zero_rows=True)


def hybrid(queries: DataFrame, chunks: DataFrame, *, alpha: float | Column = 0.4, fusion: str = "convex", first: int = 20, fused: int = 15, final: int = 6,
           where: Column | None = None, post: Column | None = None, key: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """Dense and sparse candidates of the chunks that pass `where`, fused, cut, filtered by `post`, reranked.

    queries: query_id, query, query_vector; chunks: key, text, embedding. Dense candidates come from
    products of blocks; chunks without a shared term stay eligible at score 0 on the sparse side.
    `fusion` is "convex" (weighted normalised scores) or "rrf" (reciprocal ranks).
    """
    if fusion not in ("convex", "rrf"):
        raise ValueError(f"unknown fusion {fusion!r}")
    queries, chunks = staged(queries, "queries"), staged(chunks if where is None else chunks.filter(where), "chunks")
    dense, sparse = candidate_lists(queries, chunks, first, key=key, digits=digits)
    both = fuse_convex(dense, sparse, alpha, key=key) if fusion == "convex" else fuse_ranks([dense, sparse], key=key)
    cut = top_k(both, fused, key=key, digits=digits).select("query_id", key)
    rows = cut.join(queries.select("query_id", "query"), "query_id").join(chunks.drop("embedding"), key)
    return rerank(rows if post is None else rows.filter(post), final, key=key)


def tenant_hits(queries: DataFrame, chunks: DataFrame, k: int, *, key: str = "chunk_id") -> DataFrame:
    """Dense top k within the query's tenant only."""
    return dense_top_k(queries, chunks, k, key=key, on=["tenant"])


def approximate_neighbours(vectors: DataFrame, *, key: str, least: float, tables: int = 8, bucket: float = 1.0) -> DataFrame:
    """Pairs whose cosine reaches `least`, by random projections; approximate: pairs that share no bucket are missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = F.transform("embedding", lambda x: x / C.norm(F.col("embedding")))
    rows = vectors.select(key, array_to_vector(unit).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket, seed=1).fit(rows)
    far = float(np.sqrt(max(0.0, 2 - 2 * least)))
    pairs = model.approxSimilarityJoin(rows, rows, far, "distance")
    pairs = pairs.select(F.col(f"datasetA.{key}").alias("a"), F.col(f"datasetB.{key}").alias("b"), (1 - F.col("distance") ** 2 / 2).alias("similarity"))
    return pairs.filter("a < b")


def annotate_scores(pairs: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], *, batch: int = 64) -> DataFrame:
    """Adds `score` of (query, text). `scorer()` is called once a task and gives a function of queries and texts.

    It is fed `batch` pairs of like length at a time, so that a model that pads wastes little. Nulls reach it as empty texts.
    """

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for q, t in parts:
            q, t = q.fillna("").to_numpy(), t.fillna("").to_numpy()
            order = np.argsort([len(a) + len(b) for a, b in zip(q, t, strict=True)], kind="stable")
            score = np.empty(len(q))
            for i in range(0, len(q), batch):
                some = order[i : i + batch]
                score[some] = model(q[some].tolist(), t[some].tolist())
            yield pd.Series(score)

    # Said to be nondeterministic, so that no filter on the score is pushed below a join and scores what the join leaves out.
    return pairs.withColumn("score", run.asNondeterministic()("query", "text"))


def pair_bound(query: Column, text: Column) -> Column:
    """The most that `hooks.pair_scorer` can give: every neighbouring pair of terms counts whose two terms the text holds."""
    words, held = C.tokens(query), F.array_intersect(C.tokens(query), C.tokens(text))
    count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.array_distinct(F.arrays_zip(F.slice(words, 1, count).alias("a"), F.slice(words, 2, count).alias("b")))
    likely = F.filter(pairs, lambda p: F.array_contains(held, p["a"]) & F.array_contains(held, p["b"]))
    share = lambda some, of: F.coalesce(F.try_divide(F.size(some).cast("double"), F.size(of)), F.lit(0.0))
    return 0.5 * share(held, F.array_distinct(words)) + 0.5 * share(likely, pairs)


def rerank_cascade(candidates: DataFrame, k: int, scorer, bound: Column, *, key: str = "chunk_id", batch: int = 64) -> DataFrame:
    """`rerank` by a Python scorer that sees only candidates whose `bound`, never below their score, can bring them among the k best.

    The k candidates of the highest bounds are scored and written first; of the others those follow whose bound reaches
    the k-th score so far. The result is that of scoring all. candidates: query_id, query, key, text, one row a query and
    key; they are read twice. A null bound rules nothing out. A candidate whose score is null or no number is left out.
    """
    spark = candidates.sparkSession
    bounded = candidates.select("query_id", "query", key, "text", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    by_bound = W.partitionBy("query_id").orderBy(F.desc("bound"), key)
    leading = bounded.withColumn("turn", F.row_number().over(by_bound)).filter(F.col("turn") <= k)
    path = shared_path(spark, "rerank")
    annotate_scores(leading, scorer, batch=batch).select("query_id", key, "bound", "score").write.parquet(path)
    first = spark.read.parquet(path)
    real = F.col("score").isNotNull() & ~F.isnan("score")
    edge = first.groupBy("query_id").agg(
        F.max(F.struct((-F.col("bound")).alias("b"), F.col(key).alias("k"))).alias("edge"),
        F.max(F.when(real, F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))).alias("worst"),
        F.count(F.when(real, 1)).alias("scored"),
    )
    place = F.struct((-F.col("bound")).alias("b"), F.col(key).alias("k"))
    reach = F.struct((-F.col("bound")).alias("s"), F.col(key).alias("k"))
    rest = bounded.join(edge, "query_id").filter((place > F.col("edge")) & ((F.col("scored") < k) | (reach < F.col("worst"))))
    more = annotate_scores(rest.select("query_id", "query", key, "text"), scorer, batch=batch)
    scored = first.select("query_id", key, "score").unionByName(more.select("query_id", key, "score"))
    return top_k(scored.filter(real), k, key=key)
