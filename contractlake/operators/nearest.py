"""Exact nearest neighbours by cosine: cells around pivots, and the triangle bound on angles decides which cells a query meets.

At most `PIVOTS` vectors, those with the smallest hash of their id, are pivots; a vector belongs to the cell of its nearest pivot, whose radius is
the largest angle in it. No vector of a cell is closer to a query than the query's angle to the pivot less the radius. Each query first searches its
own cell, which leaves it a score to beat (`least`, where there is one, needs no such search); after that a query is sent only to the cells whose
bound reaches that score. Cells are cut into blocks and the queries of a cell into batches; block and batch meet in one matrix product. Pruning works on
vectors that cluster. On vectors without structure every query meets every cell, as it must: where the bound leaves some queries more than `WORTH` of all
pairs, cells are left aside and large batches meet large blocks, so that a vector is sent once a block and not once a cell. Products are taken in single
precision; only pairs within its error of the score that counts are taken again in double precision, which decides.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.session import staged

#: Most pivots; vectors of a block and queries of a batch; what rounding may add to a bound.
PIVOTS, BLOCK, BATCH, SLACK = 1_024, 8_192, 4_096, 1e-6
#: Most vectors of a block and queries of a batch without cells; share of the pairs below which cells are worth it; queries that tell this share.
SIDE, WORTH, TOLD = 32_768, 0.2, 2_000


class Cells(NamedTuple):
    """Pivots (unit rows) and the radius of each cell; cells without vectors have radius -1. The last cell holds vectors of length 0 and those with a component that is no finite number."""

    pivots: np.ndarray
    radius: np.ndarray


def _units(column: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in column])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def cells_of(vectors: DataFrame, most: int = PIVOTS) -> tuple[DataFrame, Cells]:
    """`vectors` (id, v, ...) with `cell`, written; and the cells. The driver sees pivots and one row a cell."""
    n = min(most, max(1, int(vectors.count() ** 0.5)))
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    some = vectors.filter(F.exists("v", lambda x: x != 0) & whole).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(n).toPandas()
    pivots = np.unique(_units(some["v"]), axis=0) if len(some) else np.zeros((0, 0))

    @F.pandas_udf("cell int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        units = _units(v)
        if not len(pivots):
            return pd.DataFrame({"cell": 0, "angle": np.pi}, index=range(len(units)))
        none = ~units.any(axis=1) | ~np.isfinite(units).all(axis=1)
        angles = _angles(np.where(none[:, None], 0.0, units), pivots)
        cell = angles.argmin(axis=1)
        return pd.DataFrame({"cell": np.where(none, len(pivots), cell).astype(np.int32), "angle": np.where(none, np.pi, angles[np.arange(len(units)), cell])})

    placed = staged(vectors.withColumn("p", place("v")).select(*vectors.columns, "p.cell", "p.angle"), "cells")
    radius = np.full(len(pivots) + 1, -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    return placed, Cells(pivots, radius)


def wanted_cells(queries: DataFrame, cells: Cells, *, own: bool = False) -> DataFrame:
    """Adds `cell` to queries (id, v, beat, ...), a row for each cell that may hold a vector of cosine `beat` or more (null: any); own: for the nearest cell only."""

    @F.pandas_udf("array<int>")
    def meet(v: pd.Series, beat: pd.Series) -> pd.Series:
        units = _units(v)
        there = cells.radius >= 0
        if not len(cells.pivots):
            return pd.Series([np.flatnonzero(there).astype(np.int32)] * len(units))
        angles = np.concatenate([_angles(units, cells.pivots), np.zeros((len(units), 1))], axis=1)
        if own:
            open_ = np.zeros(angles.shape, bool)
            open_[np.arange(len(units)), np.where(there[:-1], angles[:, :-1], 9.0).argmin(axis=1)] = True
        else:
            bound = np.cos(np.maximum(angles - cells.radius, 0.0))
            open_ = bound >= np.nan_to_num(beat.to_numpy(float), nan=-2.0)[:, None] - SLACK
            open_[:, -1] = True
            open_[~units.any(axis=1)] = True
        return pd.Series([np.flatnonzero(x & there).astype(np.int32) for x in open_])

    return queries.withColumn("cell", F.explode(meet("v", F.col("beat").cast("double"))))


def _best_pairs(q: np.ndarray, c: np.ndarray, k: int, least: float | None, digits: int, barred=None, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `q`, rows of `c`, cosines: for each row of `q` (unit rows, as those of `c`) the k best of `c`, ties to the first.

    `barred(i, j)`: pairs left out; `single`: `c` in single precision.
    """
    slack = (q.shape[1] + 8) * 2.0**-22 + 2 * 10.0**-digits
    s = q.astype(np.float32) @ (c.astype(np.float32) if single is None else single).T
    edge = np.float32(-9.0 if least is None else least - slack)
    near = np.flatnonzero(s >= edge) if least is not None else None
    if len(c) > k and (least is None or len(near) > max(64, 8 * k) * len(q)):
        if barred is not None:
            s[barred(np.arange(len(q))[:, None], np.arange(len(c))[None])] = -np.inf
        edge = np.maximum(edge, np.partition(s, len(c) - k, axis=1)[:, [len(c) - k]] - np.float32(2 * slack))
        near = None
    i, j = np.divmod(np.flatnonzero(s >= edge) if near is None else near, len(c))
    if barred is not None:
        free = ~barred(i, j)
        i, j = i[free], j[free]
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 17):
        some = slice(at, at + (1 << 17))
        exact[some] = np.einsum("nd,nd->n", q[i[some]], c[j[some]])
    exact = np.round(exact, digits) + 0.0  # no negative zeros
    if least is not None:
        good = exact >= least
        i, j, exact = i[good], j[good], exact[good]
    order = np.lexsort((j, -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], exact[first]


def _products(asked: DataFrame, placed: DataFrame, k: int, *, least: float | None, apart: bool, block: int, digits: int, batch: int = BATCH, parts: int | None = None) -> DataFrame:
    """query_id, found, score: of each batch of queries the k best in each block of their cells. `parts`: into how many tasks they are dealt."""
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_block"))
    batches = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("n_batch"))
    sizes = F.broadcast(blocks.join(batches, "cell"))  # one row a cell, at most PIVOTS + 1
    side = lambda df, own, other: df.join(sizes, "cell").select(
        "id", "v", "g", "cell", F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
    )
    left, right = side(asked, "batch", "block"), side(placed, "block", "batch")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "found": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(q) or not len(c):
            return empty
        c = c.sort_values("id")  # ties go to the smaller id
        whole = lambda df, units: (df["id"].to_numpy()[good := np.isfinite(units).all(axis=1)], df["g"].to_numpy(float)[good], units[good])
        (ids, groups, cu), (asks, own, qu) = whole(c, _units(c["v"])), whole(q, _units(q["v"]))
        out, single, step = [], cu.astype(np.float32), max(64, (1 << 22) // max(len(ids), 1))
        for at in range(0, len(asks) if len(ids) else 0, step):
            mine, g = asks[at : at + step], own[at : at + step]
            barred = (lambda i, j, mine=mine, g=g: (g[i] == groups[j]) | (mine[i] == ids[j])) if apart else None
            i, j, score = _best_pairs(qu[at : at + step], cu, k, least, digits, barred, single)
            out.append(pd.DataFrame({"query_id": mine[i], "found": ids[j], "score": score}))
        return pd.concat(out) if out else empty

    keys = ("cell", "block", "batch")
    if parts is not None:  # dealt by number, so that adaptive execution does not put products of small inputs into one task
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, found long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def score_to_beat(queries: DataFrame, placed: DataFrame, cells: Cells, k: int, *, least: float | None, apart: bool, block: int = BLOCK, digits: int = 9) -> DataFrame:
    """queries (id, v, g) with `beat`: `least`, or the k-th best score in the query's own cell; null where it holds fewer."""
    if least is not None:
        return queries.withColumn("beat", F.lit(float(least)))
    own = wanted_cells(queries.withColumn("beat", F.lit(None).cast("double")), cells, own=True)
    found = best_of(_products(own, placed, k, least=None, apart=apart, block=block, digits=digits), k).filter(F.col("rank") == k)
    return queries.join(found.select(F.col("query_id").alias("id"), F.col("score").alias("beat")), "id", "left")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, least: float | None = None, apart: bool = False, block: int = BLOCK, digits: int = 9, pivots: int = PIVOTS) -> DataFrame:
    """query_id, found, score, rank: the k vectors (id, v, g) of greatest cosine for each query (id, v, g), those below `least` left out.

    `apart`: pairs of one id, or of equal g, are left out. Scores are rounded to `digits` before they are compared.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    placed, cells = cells_of(vectors, pivots)
    some = wanted_cells(score_to_beat(queries.limit(TOLD), placed, cells, k, least=least, apart=apart, block=block, digits=digits), cells)
    met = some.groupBy("cell").count().join(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held")), "cell").agg(F.sum(F.col("count") * F.col("held"))).first()[0]
    if (met or 0) > WORTH * min(n_queries, TOLD) * n_vectors:
        size = lambda n, least_size: int(min(max(SIDE, least_size), max(least_size, -(-n // 8))))
        side, batch = size(n_vectors, min(block, 1_024)), size(n_queries, 1_024)
        parts = min(2_000, 2 * -(-n_vectors // side) * -(-n_queries // batch))
        one = lambda df: df.select("id", "v", "g", F.lit(0).alias("cell"))
        return best_of(_products(one(staged(queries, "asked")), one(placed), k, least=least, apart=apart, block=side, digits=digits, batch=batch, parts=parts), k)
    asked = wanted_cells(score_to_beat(queries, placed, cells, k, least=least, apart=apart, block=block, digits=digits), cells)
    return best_of(_products(staged(asked, "asked"), placed, k, least=least, apart=apart, block=block, digits=digits), k)
