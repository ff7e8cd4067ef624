"""Integer inner products of large, tied and clashing vectors against brute force."""

import math

from pyspark.sql import functions as F

from contractlake.llm import inner_products


def brute(rows, every=50, k=5):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = []
    for q in (i for i in whole if i % every == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_large_finite_components_take_part(spark):
    # Products pass 2 ** 53, where doubles round; the second pair differs in the last unit only.
    rows = [(0, [1e6, 1.0, 1.0]), (1, [1e6, 1.0, 1.0]), (2, [1e6, 1.0, 1.00390625]), (3, [-1e6, 0.0, 0.0]), (4, [0.5, 0.25, 0.0]), (50, [0.0, 0.0, 1.0]), (5, [1e15, 1.0, 0.0])]
    rows += [(100 + i, [0.03125, 0.5, 0.0]) for i in range(30)]
    bad = [(6, [float("inf"), 0.0, 0.0]), (7, None), (8, [None, 1.0, 1.0]), (9, [float("nan"), 1.0, 1.0])]
    rows[-1] = (200, [0.0, 0.0, 0.0])
    small = [r for r in rows if r[0] != 5]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash")).withColumn("block", F.lit(1))
    got = sorted(tuple(r) for r in inner_products.top_k(frame(small + bad)).collect())
    assert got == brute(small)
    some = [r for r in rows if r[0] != 0 and abs(r[1][0]) < 1e6 or r[0] == 5]
    assert any(r[0] == 5 for r in some)
    got = sorted(tuple(r) for r in inner_products.top_k(frame(some + bad)).collect())
    assert got == brute(some)
