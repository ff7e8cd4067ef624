"""Sentence pieces of awkward texts against the model's own library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractlake.llm import sentence_pieces

random.seed(7)
LETTERS = "etaoinshrdlu"
TEXTS = [
    "a" * 3001, "=" * 777, " " * 500, "x" + " " * 90 + "y", "\n" * 200, "▁▁ literal ▁sign", " lead", "trail ", "日本語のテキスト" * 20, "\u0000\u0001",
    "".join(random.choice(LETTERS) for _ in range(5000)), "the" * 400, "Ünï" * 100, "é" * 130, "____" * 50 + "a", "😀" * 70, "1234567890" * 30,
    "".join(random.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(4000)), "", None, "the cat", "the cat",
]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("stretch,block", [(1 << 20, 1 << 24), (64, 500)])
def test_every_length_equals_the_library(spark, model, monkeypatch, stretch, block):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = sentence_pieces.load(model)
    borders = sentence_pieces.Borders(pieces)
    monkeypatch.setattr(sentence_pieces, "STRETCH", stretch)
    for text in filter(None, TEXTS):  # the cuts alone: what they give is the text again
        raw = b" " + text.replace("▁", " ").encode()
        found, begins, runs = borders.cut(raw, np.array([0]))
        assert sum(map(len, found)) == len(begins)
        assert runs or "".join("".join(x.to_pylist()) for x in found).encode() == raw
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(2)
    got = {r["doc_id"]: r for r in sentence_pieces.encode_documents(docs, model, block_bytes=block).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == library.encode(t or ""), (i, t and t[:20])
        assert got[i]["round_trip"] and got[i]["n_pieces"] == len(got[i]["ids"])


def test_windows_without_a_common_piece_go_to_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = sentence_pieces.load(model).all_texts
    for text in (" " + "ab" * 60, "ab" * 60):
        windows = [text[k : k + 56] for k in range(0, len(text) - 56 + 28, 28)]
        single = [np.array([i for c in w for i in library.encode("\n" + c)[len(library.encode("\n")) :]] if k % 2 else library.encode("\n" + w)[len(library.encode("\n")) :]) for k, w in enumerate(windows)]  # noqa: E501
        want = library.encode(text[1:]) if text[0] == " " else library.encode("\n" + text)[len(library.encode("\n")) :]
        assert sentence_pieces.join_windows(single, texts, model).tolist() == want
