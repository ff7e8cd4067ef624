"""Searches of the stored index score in groups, dealt into more tasks the larger the index is; hybrid search reads its chunks once."""

import random

from pyspark.sql import functions as F

from contractlake.operators import retrieval, search_index

CHUNKS, QUERIES = "chunk_id long, text string", "query_id long, query string"


def texts(n, seed=5):
    rng = random.Random(seed)
    return [(i * 7 - 900, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_scores_are_dealt_by_the_size_of_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "RUN", 1, raising=False)
    monkeypatch.setattr(search_index, "BATCH", 2, raising=False)
    frame = spark.createDataFrame(texts(500), CHUNKS)
    index = search_index.build(frame, str(tmp_path / "index"))
    asked = search_index.asked_terms(spark.createDataFrame([(q, f"w1 w1 w{q}") for q in range(2, 7)], QUERIES), index)
    slots = search_index.slot_bounds(asked, index)
    scores = search_index.slot_scores(asked, slots, index)
    assert scores.rdd.getNumPartitions() >= 500 // search_index.SLOT
    queries = asked.select("query_id").distinct().select("query_id", F.format_string("w1 w1 w%d", "query_id").alias("query"))
    want = retrieval.bm25_scores(queries, retrieval.bm25_index(frame))
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(scores) == rows(want)


def test_copies_of_a_text_go_by_key(spark):
    chunks = spark.createDataFrame([(900 - i, "one two three" if i % 2 else "one") for i in range(300)], CHUNKS)
    got = retrieval.sparse_top_k(spark.createDataFrame([(1, "two")], QUERIES), chunks, 4, digits=6).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [601, 603, 605, 607]


def test_hybrid_reads_its_chunks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    chunks = spark.createDataFrame([(i, t, [float(i % 5), 1.0]) for i, (_, t) in enumerate(texts(40))], "chunk_id long, text string, embedding array<double>")
    chunks = chunks.withColumn("text", F.udf(count, "string").asNondeterministic()("text"))
    asked = spark.createDataFrame([(1, "w1 w2", [1.0, 0.0])], "query_id long, query string, query_vector array<double>")
    assert retrieval.hybrid(asked, chunks, fusion="rrf").count() == 6
    assert seen.value == 40
