"""What the classifiers learn from: whole texts, and each id once, however often it is repeated; numbers of more fragments than three bytes hold."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contractlake.llm import language_id, sentence_pieces, toxicity


def test_shares_count_the_whole_of_a_very_long_text(spark):
    text = "abc " * 400_000 + "xyz " * 400_000  # two halves of 1.6 MB each
    rows = [(i, text if i == 0 else "abc abc", "en") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("clash"))
    got = language_id._sample(docs.select("doc_id", "text", "lang"))
    second = sorted(set(language_id.subwords(b"xyz " * 9).tolist()) - set(language_id.subwords(b"abc " * 9).tolist()))
    found = []
    for buckets, shares in zip(got["buckets"], got["shares"]):
        buckets, shares = np.frombuffer(buckets, "<u2"), np.frombuffer(shares, "<f4")
        assert abs(shares.sum() - 1) < 1e-4 and (np.diff(buckets.astype(int)) > 0).all()
        found.append(round(float(shares[np.isin(buckets, second)].sum()), 2))
    assert set(found) <= {0.0, 0.5}
    whole = language_id.subwords(text.encode())
    buckets, shares = language_id.shares(text.encode())
    assert np.allclose(np.bincount(whole, minlength=language_id.BUCKETS)[buckets] / len(whole), shares, atol=1e-4)


def test_repeats_of_one_id_do_not_crowd_out_the_others(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    words = {"aa": "eins zwei drei vier", "bb": "uno due tre quattro"}
    rows = [(i, f"{words['aa' if i % 2 else 'bb']} {i % 7}", "aa" if i % 2 else "bb") for i in range(300)]
    hashed = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.xxhash64("doc_id", F.lit("language")).alias("h"))
    first = hashed.filter(language_id.remainder(F.col("doc_id"), 3) != 1).orderBy("h").first()
    docs = spark.createDataFrame(rows + [(first["doc_id"], first["text"], first["lang"])] * 6_000, "doc_id long, text string, lang string").repartition(4)
    sample = language_id._sample(docs)
    assert len(sample) == 60 and sample["h"].nunique() == 60 and set(sample["lang"]) == {"aa", "bb"}
    got = language_id.predict(docs).filter("held_out").distinct().collect()
    assert len(got) > 80 and all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") for r in got)

    bad = [(i, int(i % 5 == 0)) for i in range(300)]
    one = spark.createDataFrame(bad, "doc_id long, toxic int").select("*", F.xxhash64("doc_id", F.lit("toxicity")).alias("h"))
    first = one.filter(toxicity.remainder(F.col("doc_id"), 4) != 2).orderBy("h").first()
    labels = spark.createDataFrame(bad + [(first["doc_id"], first["toxic"])] * 20_000, "doc_id long, toxic int").repartition(4)
    texts = [(i, ("grobian " if i % 5 == 0 else "") + f"word{i % 11} other") for i in range(300)]
    many = spark.createDataFrame(texts + [(first["doc_id"], "word1 other")] * 20_000, "doc_id long, text string").repartition(4)
    learned = toxicity._sample(many, labels)
    assert learned.count() == 60 and learned.select("toxic").distinct().count() == 2


def test_all_capitals_count():
    one = toxicity.Featurizer({})
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        assert one(f"{letter}a".encode())[14] == 0.5
    assert one(b"abc")[14] == 0 and one(b"")[14] == 0


def test_numbers_wider_than_three_bytes(monkeypatch):
    """A block with more fragments than the narrow plane numbers gives the same order of fragments."""

    class Borders:
        def cut(self, text, heads):
            words = text.split(b" ")[1:]
            begins = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
            return [pa.array([w.decode() for w in words])], begins, []

    def numbers():
        block = sentence_pieces._Block(Borders())
        for i in range(3):
            block.add(i, " ".join(f"w{k * (i + 1)}" for k in range(200)).encode())
        first = next(iter(block.rows(0, pa.int64(), 4)))
        return [sentence_pieces.numbers_of(*(first.column(c)[i].as_py() for c in ("low", "middle", "high"))) for i in range(3)], len(first.column("high")[0].as_py())

    narrow, one = numbers()
    monkeypatch.setattr(sentence_pieces, "NARROW", 100)
    wide, two = numbers()
    assert two == 2 * one and all((a == b).all() for a, b in zip(narrow, wide))
    assert (sentence_pieces.numbers_of(b"\x01", b"\x02", b"\x03\x04") == 0x04030201).all()
