"""The stored index against full sums, and the containment join against plain search."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contractlake.operators import retrieval, search_index

CHUNKS, QUERIES = "chunk_id long, text string", "query_id long, query string"


def scores_by_loop(chunks, query):
    docs = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in chunks}
    n, avgdl = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = {}
    for i, c in docs.items():
        shared = [t for t in re.findall("[a-z0-9]+", query.lower()) if t in c]
        if shared:
            out[i] = sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for t in shared)
    return out


def top_by_loop(chunks, query, k, zero_rows):
    scores = scores_by_loop(chunks, query)
    if zero_rows:
        scores |= {i: 0.0 for i, _ in chunks if i not in scores}
    return [i for i, _ in sorted(((i, round(s, 6) + 0.0) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    chunks = [(i * 3 - 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(10**12, None), (10**12 + 1, "")]
    return chunks, [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for q in range(12)] + [(99, "nothing known"), (100, "")]


@pytest.mark.parametrize(("seed", "n", "slot"), [(1, 400, 4), (2, 30, 64)])
def test_search_equals_full_sums(spark, tmp_path, seed, n, slot):
    chunks, queries = corpus(seed, n)
    frame, asked = spark.createDataFrame(chunks, CHUNKS).withColumn("slot", F.lit("clash")).repartition(3), spark.createDataFrame(queries, QUERIES)
    index = search_index.build(frame.select("chunk_id", "text"), str(tmp_path / "index"), slot=slot)
    for zero_rows in (False, True):
        got = {}
        for r in search_index.search(asked, search_index.open_index(spark, str(tmp_path / "index")), 5, digits=6, zero_rows=zero_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        want = {q: top for q, text in queries if (top := top_by_loop(chunks, text, 5, zero_rows))}
        assert got == want
    full = retrieval.bm25_scores(asked, retrieval.bm25_index(frame.select("chunk_id", "text")))
    best = retrieval.top_k(full, 5, digits=6).select("query_id", "rank", "chunk_id", "score")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, search_index.search(asked, index, 5, digits=6).select("query_id", "rank", "chunk_id", "score").collect()))
    slots = search_index.open_slots(search_index.asked_terms(asked, index), index, 5)
    if slot == 4:
        assert slots.filter("not opened").count() > 0.3 * slots.count()


def test_negative_scores_stand_behind_zero_rows(spark):
    chunks = spark.createDataFrame([(i, "common also" if i < 5 else "other") for i in range(7)], CHUNKS)
    got = retrieval.sparse_top_k(spark.createDataFrame([(1, "common")], QUERIES), chunks, 2, zero_rows=True).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(5, 0.0), (6, 0.0)]


def test_text_keys_and_empty_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("b", "one two"), ("a", "one"), ("c", None)], "chunk_id string, text string")
    index = search_index.build(chunks, str(tmp_path / "t"))
    got = search_index.search(spark.createDataFrame([(1, "two two one")], QUERIES), index, 3, zero_rows=True).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "b" and len(got) == 3
    none = search_index.build(spark.createDataFrame([], CHUNKS), str(tmp_path / "none"))
    assert search_index.search(spark.createDataFrame([(1, "two")], QUERIES), none, 3, zero_rows=True).count() == 0


def test_containing(spark):
    texts = ["a big red cat sat down", "concat sat down here now, x", "", None, "one", "a\tbig red cat  sat down", "the the the the"]
    passages = ["big red cat", "g red cat s", "cat sat down here n", "one", "the the the", "ed c", "red cat sat down!", "a\tbig red cat  sat", "cat  s"]
    t = spark.createDataFrame(list(enumerate(texts)), CHUNKS)
    p = spark.createDataFrame(list(enumerate(passages)), QUERIES)
    got = sorted(tuple(r) for r in retrieval.containing(p, t).select("query_id", "chunk_id").collect())
    assert got == sorted((q, i) for q, a in enumerate(passages) for i, b in enumerate(texts) if b is not None and a in b)
    long = p.filter("query_id in (2, 6)")
    assert "NestedLoop" not in retrieval.containing(long, t)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.containing(p.filter("false"), t).count() == 0
