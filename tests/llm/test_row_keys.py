"""Rows that share a hash are told apart in language-model scores."""

from pyspark.sql import functions as F

from contractlake.llm import language_model as L

ROWS = [(i, f"a b{i % 5} c a b{i % 3} " * (1 + i % 4)) for i in range(40)] + [(3, "again a b"), (3, "again a b"), (None, "a b1 c"), (7, None), (None, None), (8, "")]


def test_rows_that_share_a_hash_keep_their_own_scores(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plain = lambda: sorted(map(str, L.score_documents(docs).select("doc_id", "n_words", F.round("log_score", 6)).collect()))
    before, real = plain(), L._hash
    assert len(before) == len(ROWS)
    # Seed 0 leaves four hashes, seed 1 sixty-four: two rounds of others are needed at least.
    monkeypatch.setattr(L, "_hash", lambda seed: F.pmod(real(seed), F.lit({0: 4, 1: 64}.get(seed, 1 << 62))))
    key, n = L.row_key(docs)
    keys = docs.select("doc_id", "text", key.alias("k")).distinct()
    assert n == len(ROWS)
    assert keys.count() == keys.select("k").distinct().count() == len(set(ROWS))
    assert plain() == before


def test_row_key_of_no_rows(spark):
    assert L.row_key(spark.createDataFrame([], "doc_id long, text string"))[1] == 0
