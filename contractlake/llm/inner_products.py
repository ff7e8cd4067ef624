"""Exact top-k by integer inner product over norm-sorted vectors.

Components become floor(scale * x). Vectors are cut into blocks by descending length; the longest
block is searched first and leaves each query a score to beat. In a block, vectors go by descending
length in chunks: once |q||v| can't reach the score to beat, the rest of the block is skipped for
the query; otherwise both are turned by the singular vectors of a sample, the leading coordinates
are multiplied, and the Cauchy-Schwarz bound of the remaining ones prunes pairs. Survivors get the
full integer product: in double precision where no product of lengths reaches 2 ** 53, else in
64-bit integers. A component or score that 63 bits can't hold raises an error.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an
id; all finite vectors do. Of rows that share an id the one with the greatest vector counts. Only vectors of one length
are compared. Ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.llm.common import stage

#: No score yet.
NONE = -(1 << 63)
#: Vectors of a block, queries of a block, vectors of a chunk; rows that the rotation is fitted on; share of the coordinates that lead.
BLOCK, QUERY_BLOCK, CHUNK, SAMPLE_ROWS, LEADING = 8_192, 4_096, 1_024, 5_000, 0.5


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (array<bigint>), dim, norm2 of the usable rows of `vectors` (vec_id, embedding)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fit = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    whole = lambda e: F.when(F.abs(e * scale) < float(1 << 63), F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component exceeds 63 bits")).cast("bigint"))
    rows = vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fit))
    rows = rows.select("vec_id", F.transform("x", whole).alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.withColumn("dim", F.size("v")).withColumn("norm2", norm2)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns, those of the largest spread first, from at most SAMPLE_ROWS rows."""
    sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, float) for v in sample]).reshape(len(sample), dim)
    return np.linalg.svd(x.T @ x)[0] if dim else np.zeros((0, 0))


def search_block(queries: np.ndarray, ids: np.ndarray, to_beat: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, turn: np.ndarray, k: int):
    """(query index, vec_id, score) of the best k of each query among `vectors`, none below its score to beat (NONE: no such)."""
    whole_q, whole_v = queries.astype(np.int64), vectors.astype(np.int64)
    queries, vectors = queries.astype(float), vectors.astype(float)
    order = np.lexsort((vec_ids, -np.einsum("ij,ij->i", vectors, vectors)))
    vectors, vec_ids, whole_v = vectors[order], vec_ids[order], whole_v[order]
    lengths, q_lengths = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    lead = int(round(turn.shape[0] * LEADING))
    vt, qt = vectors @ turn, queries @ turn
    v_rest, q_rest = np.linalg.norm(vt[:, lead:], axis=1), np.linalg.norm(qt[:, lead:], axis=1)
    rounds = q_lengths.max(initial=0) * lengths.max(initial=0) >= 2.0**53
    least = to_beat.astype(np.int64)
    floor_ = np.where(least == NONE, -np.inf, least.astype(float))
    best_s, best_i = np.full((len(queries), k), NONE, np.int64), np.full((len(queries), k), np.iinfo(np.int64).max)
    for at in range(0, len(vectors), CHUNK):
        end = min(len(vectors), at + CHUNK)
        live = np.flatnonzero(q_lengths * lengths[at] * (1 + 1e-9) + 1e-6 >= floor_)
        if not len(live):
            break
        bound = qt[live, :lead] @ vt[at:end, :lead].T + np.outer(q_rest[live], v_rest[at:end])
        maybe = bound + 1e-6 * (1 + np.abs(bound)) >= floor_[live, None]
        full = live[maybe.any(axis=1)]
        if not len(full):
            continue
        scores = queries[full] @ vectors[at:end].T
        out = ~maybe[maybe.any(axis=1)] | (ids[full, None] == vec_ids[None, at:end])
        if rounds:
            if (np.abs(scores[~out]) >= 9.2e18).any():
                raise OverflowError("a score exceeds 63 bits")
            scores = whole_q[full] @ whole_v[at:end].T
        scores = scores.astype(np.int64)
        scores[out] = NONE
        keep = min(k, end - at)
        # The k-th best of the chunk bounds what can enter; all that reach it are ranked with their ids.
        edge = np.maximum(np.partition(scores, end - at - keep, axis=1)[:, end - at - keep], least[full])
        r, c = np.nonzero((scores >= edge[:, None]) & (scores != NONE))
        for row in np.unique(r):
            cols = c[r == row]
            q = full[row]
            s, i = np.concatenate([best_s[q], scores[row, cols]]), np.concatenate([best_i[q], vec_ids[at + cols]])
            top = np.lexsort((i, ~s))[:k]  # ~s falls as s rises, and NONE has one
            best_s[q], best_i[q] = s[top], i[top]
            if best_s[q][-1] > least[q]:
                least[q] = best_s[q][-1]
                floor_[q] = float(least[q])
    q, slot = np.nonzero(best_s != NONE)
    return q, best_i[q, slot], best_s[q, slot]


def _search(queries: DataFrame, blocks: DataFrame, turns: dict[int, np.ndarray], k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each query in each block. queries: query_id, dim, q, to_beat, q_block."""
    pairs = blocks.select("dim", "block").distinct().join(queries.select("dim", "q_block").distinct(), "dim")
    # New names for one side's columns: both stem from one table, and a grouping by name must tell them apart.
    asked = queries.join(pairs, ["dim", "q_block"]).select(F.col("dim").alias("d"), F.col("q_block").alias("qb"), F.col("block").alias("b"), "query_id", "q", "to_beat")
    held = blocks.join(pairs, ["dim", "block"])

    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(key[0])
        mat = lambda s: np.array([np.asarray(v, np.int64) for v in s]).reshape(len(s), dim)
        ids = q["query_id"].to_numpy()
        at, vec, score = search_block(mat(q["q"]), ids, q["to_beat"].to_numpy(np.int64), mat(c["v"]), c["vec_id"].to_numpy(), turns[dim], k)
        return pd.DataFrame({"query_id": ids[at], "vec_id": vec, "score": score.astype(np.int64)})

    return asked.groupBy("d", "qb", "b").cogroup(held.groupBy("dim", "q_block", "block")).applyInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for rows of `vectors` whose id is divisible by `every`, the k best among all others."""
    rows = stage(quantised(vectors, scale), "vectors")
    dims = sorted(r["dim"] for r in rows.groupBy("dim").count().collect())  # one row a length of vector
    turns = {d: rotation(rows, d) for d in dims}
    n = rows.count()
    buckets = max(1, -(-n // BLOCK))
    cuts = rows.approxQuantile("norm2", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts), reverse=True)]) if cuts else F.array().cast("array<double>")
    placed = rows.withColumn("level", F.size(F.filter(edges, lambda e: e > F.col("norm2"))))
    # Many vectors of one length (copies of one, say) are spread over several blocks of the level.
    split = placed.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("splits", F.ceil(F.col("n") / BLOCK).cast("long")).drop("n")
    placed = placed.join(F.broadcast(split), ["dim", "level"])  # one row a level: n / BLOCK rows at most
    placed = placed.withColumn("block", F.col("level") * 1_000_000 + F.pmod(F.xxhash64("vec_id"), F.col("splits")))
    placed = stage(placed.select("vec_id", "v", "dim", "level", "block"), "vector-blocks")
    q_blocks = max(1, -(-n // every // QUERY_BLOCK))
    queries = placed.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("q_block")
    )
    first = placed.join(placed.groupBy("dim").agg(F.min("level").alias("level")), ["dim", "level"])
    rest = placed.join(placed.groupBy("dim").agg(F.min("level").alias("low")), "dim").filter("level > low")
    never = F.lit(NONE).cast("bigint")
    head = stage(_best(_search(queries.withColumn("to_beat", never), first, turns, k), k), "top-first")
    beat = head.filter(F.col("rank") == k).select("query_id", F.col("score").alias("to_beat"))
    asked = queries.join(beat, "query_id", "left").withColumn("to_beat", F.coalesce("to_beat", never))
    found = head.select("query_id", "vec_id", "score").unionByName(_search(asked, rest, turns, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
