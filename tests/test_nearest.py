"""Pruned nearest neighbours against all pairs, on clustered vectors, zeros, copies and empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractlake.operators import nearest

SCHEMA = "id long, v array<double>, g long"


def clustered(n=900, clusters=12, d=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    x = centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, d))
    x[5] = 0
    x[7:12] = x[6]
    return x


def by_loop(x, asked, k, least=None, groups=None):
    units = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in asked:
        s = np.round(units[q] @ units.T, 9) + 0.0
        rows = [(-s[i], i) for i in range(len(x)) if (least is None or s[i] >= least) and (groups is None or i != q and groups[i] != groups[q])]
        out[q] = [i for _, i in sorted(rows)[:k]]
    return {q: found for q, found in out.items() if found}


def rows_of(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["found"])
    return out


@pytest.mark.parametrize(("least", "apart"), [(None, False), (None, True), (0.97, True)])
def test_nearest_equals_all_pairs_and_meets_fewer(spark, least, apart):
    x = clustered()
    groups = [i % 4 for i in range(len(x))]
    table = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups))], SCHEMA).repartition(4)
    asked = table.filter("id % 10 = 5 or id < 12")
    want = by_loop(x, [i for i in range(len(x)) if i % 10 == 5 or i < 12], 6, least, groups if apart else None)
    assert rows_of(nearest.nearest(asked, table, 6, least=least, apart=apart, block=64)) == want
    placed, cells = nearest.cells_of(table)
    wanted = nearest.wanted_cells(nearest.score_to_beat(asked, placed, cells, 6, least=least, apart=apart), cells)
    met = wanted.join(placed.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    assert met < 0.35 * asked.count() * table.count()


def test_nearest_of_few_and_of_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [0.0, 0.0], None), (2, [1.0, 0.0], None)], SCHEMA)
    assert nearest.nearest(one, none, 3).count() == 0 and nearest.nearest(none, one, 3).count() == 0
    assert rows_of(nearest.nearest(one, one, 3)) == {1: [1, 2], 2: [2, 1]}


@pytest.mark.parametrize(("least", "apart"), [(None, False), (None, True), (0.4, True), (-0.5, True)])
def test_vectors_without_structure_are_sent_once_a_block(spark, monkeypatch, least, apart):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    x[5], x[40:60] = 0, x[39]
    groups = [i % 7 for i in range(len(x))]
    table = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups))], SCHEMA)
    sent = []
    plain = nearest._products
    monkeypatch.setattr(nearest, "_products", lambda asked, *a, **b: sent.append(asked.count()) or plain(asked, *a, **b))
    found = rows_of(nearest.nearest(table, table, 5, least=least, apart=apart, block=256))
    assert found == by_loop(x, range(len(x)), 5, least, groups if apart else None)
    assert sent[-1] == len(x)


def test_vectors_with_missing_numbers_take_no_place(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [float("nan"), 1.0], None), (3, [0.6, 0.8], None)], SCHEMA)
    i, j, score = nearest._best_pairs(np.eye(3), np.eye(3), 1, None, 9)
    assert i.tolist() == j.tolist() == [0, 1, 2] and score.tolist() == [1, 1, 1]
    assert rows_of(nearest.nearest(table.filter("id = 1"), table, 3)) == {1: [1, 3]}
