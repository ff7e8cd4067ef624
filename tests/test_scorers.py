"""Scorers in Python: a cascade equals scoring all and scores less; neighbours by random projections are measured."""

import numpy as np
from pyspark.sql import functions as F

from contractlake.functions import hooks
from contractlake.operators import retrieval


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query string, chunk_id int, text string")


def plain(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


def test_cascade_equals_scoring_all_and_scores_less(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40, n))
    queries = [(q, word(6)) for q in range(12)]
    rows = []
    for q, query in queries:
        rows += [(q, query, c, word(int(rng.integers(1, 30)))) for c in range(60)]
        rows += [(q, query, 60 + c, f"{word(3)} {query} {word(3)}") for c in range(8)]  # eight equal best scores: ties
    log = str(tmp_path / "scored")

    def counting():
        model = hooks.pair_scorer()

        def score(q, t):
            with open(log, "a") as f:
                f.write("x" * len(q))
            return model(q, t)

        return score

    pairs = candidates(spark, rows).repartition(5)
    got = plain(retrieval.rerank_cascade(pairs, 6, counting, retrieval.pair_bound(F.col("query"), F.col("text"))))
    seen = len(open(log).read())
    want = plain(retrieval.top_k(retrieval.annotate_scores(pairs, hooks.pair_scorer, batch=7), 6))
    assert got == want and len(got) == 12 * 6
    assert 12 * 6 <= seen < len(rows) / 2
    assert [c for q, c, _, _ in got if q == 0] == [60, 61, 62, 63, 64, 65]


def test_bound_never_lies_below_the_score(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(rng.choice(list("abcdef") + ["A-b", "É"], n))
    rows = [(i, word(int(rng.integers(0, 7))), i, word(int(rng.integers(0, 9)))) for i in range(400)] + [(400, None, 0, "a"), (401, "a b", 0, None), (402, None, 0, None)]
    scored = retrieval.annotate_scores(candidates(spark, rows), hooks.pair_scorer).withColumn("bound", retrieval.pair_bound(F.col("query"), F.col("text")))
    assert scored.filter("bound is null or score is null or bound < score").count() == 0
    assert scored.filter("bound > score").count() > 0


def test_cascade_with_few_missing_and_no_candidates(spark):
    none = candidates(spark, [])
    assert retrieval.rerank_cascade(none, 3, hooks.pair_scorer, F.lit(1.0)).count() == 0
    few = candidates(spark, [(1, "a b", 5, "a b"), (1, "a b", 6, "b a"), (2, None, 1, None)])
    assert plain(retrieval.rerank_cascade(few, 3, hooks.pair_scorer, F.lit(None).cast("double"))) == [(1, 5, 1.0, 1), (1, 6, 0.5, 2), (2, 1, 0.0, 1)]

    def broken():  # no number for the texts of the highest bounds
        return lambda q, t: [float("nan") if x == "bad" else float(len(x)) for x in t]

    rows = candidates(spark, [(1, "q", c, "bad" if c < 4 else "x" * c) for c in range(10)])
    got = plain(retrieval.rerank_cascade(rows, 3, broken, F.lit(100.0) - F.col("chunk_id")))
    assert got == [(1, 7, 7.0, 3), (1, 8, 8.0, 2), (1, 9, 9.0, 1)]


def test_neighbours_by_projections_find_nearly_all(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    vectors = np.repeat(centres, 5, axis=0) + rng.normal(scale=0.15, size=(300, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<double>")
    got = {(r["a"], r["b"]) for r in retrieval.approximate_neighbours(rows, key="id", least=0.9).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(want) > 500 and got <= want and len(got) >= 0.9 * len(want)
