"""Language identification: averaged hashed subword embeddings with a linear softmax.

The subwords of a text are its byte trigrams and four-grams, blanks collapsed and A-Z lower-cased,
hashed into `BUCKETS` rows of an embedding table. Their embeddings are averaged and pass a linear
softmax; table and softmax are trained by stochastic gradient descent in numpy on at most
`SAMPLE_ROWS` rows, those with the smallest hash of their id, each by all subwords of its whole
text. An id that is repeated is learned from once, by its first language and text in byte order. Prediction reads whole texts, every subword. On rows held back
from the descent a temperature is fitted, and the score below which predictions are rejected, so
that those not rejected reach `PRECISION`.

Texts that are null or have no letter are `und` with score 0. Rows without a language are not
learned from; without any, every text is `und`. Repeated rows get equal results. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlake.llm.common import remainder

#: Rows that are learned from; the size of the table; the precision that rejection keeps.
SAMPLE_ROWS, BUCKETS, DIMENSIONS, PRECISION = 2_000, 1 << 15, 16, 0.99
#: Bytes of text whose subwords are summed at once.
PIECE = 1 << 20
EPOCHS, BATCH, RATE = 4, 32, 0.5
UNKNOWN = "und"
#: Fixed values of the subword hash: odd multipliers of the golden ratio's kind.
GRAM_3, GRAM_4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\r\x0b\x0c", bytes(range(97, 123)) + b"     ")
_blanks = re.compile(rb"  +")
_ascii_letter = re.compile("[A-Za-z]")


class Model(NamedTuple):
    """`logits`: what each subword adds to each language; `bias`; `scale` (1 / temperature); `least`: rejected below."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    scale: float
    least: float


def subwords(raw: bytes) -> np.ndarray:
    """Buckets of the trigrams and four-grams of a text, in order."""
    text = np.frombuffer(b" " + _blanks.sub(b" ", raw.translate(_LOWER)).strip() + b" ", np.uint8).astype(np.uint32)
    if len(text) < 3:
        return np.zeros(0, np.uint16)
    three = text[:-2] | text[1:-1] << np.uint32(8) | text[2:] << np.uint32(16)
    four = three[:-1] | text[3:] << np.uint32(24)
    return np.concatenate([(three * GRAM_3) >> np.uint32(17), ((four ^ (four >> np.uint32(15))) * GRAM_4) >> np.uint32(17)]).astype(np.uint16)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ascii_letter.search(text)) or any(map(str.isalpha, text)))


def shares(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the subwords of a whole text fall into, ascending, and the share of the subwords in each."""
    n = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(raw), PIECE):
        n += np.bincount(subwords(raw[i : i + PIECE + 3]), minlength=BUCKETS)
    used = np.flatnonzero(n)
    return used.astype("<u2"), (n[used] / max(n.sum(), 1)).astype("<f4")


def _sample(docs: DataFrame) -> pd.DataFrame:
    """lang, buckets and shares of the rows learned from, one an id, in a fixed order."""
    h = F.xxhash64("doc_id", F.lit("language"))
    rows = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)).select(h.alias("h"), "lang", "text")
    # The smallest distinct hashes: however often an id is repeated, it takes one place.
    low = rows.groupBy("h").agg(F.max(F.col("text").rlike(r"\p{L}")).alias("usable")).filter("usable").select("h").orderBy("h").limit(SAMPLE_ROWS)
    last = low.agg(F.max("h")).first()[0]
    if last is None:
        return pd.DataFrame({"h": [], "lang": [], "buckets": [], "shares": []})
    one = rows.filter((F.col("h") <= F.lit(last)) & F.col("text").rlike(r"\p{L}")).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("x")).select("h", "x.lang", "x.text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shares(text.encode("utf-8", "replace")) for text in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "lang": batch["lang"], "buckets": [a.tobytes() for a, _ in found], "shares": [b.tobytes() for _, b in found]})

    # At most SAMPLE_ROWS rows of at most 6 * BUCKETS bytes, of most texts a few thousand.
    return one.mapInPandas(count, "h long, lang string, buckets binary, shares binary").toPandas().sort_values("h")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that any of the rows holds, and a matrix of the rows' shares of them."""
    used, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    out = np.zeros((len(rows), len(used)), np.float32)
    out[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), at] = np.concatenate([r[1] for r in rows])
    return used.astype(np.int64), out


def means(table: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The mean of the table's rows over all subwords of each text."""
    return np.stack([shares @ table[buckets] for buckets, shares in rows])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What each subword adds to each of k languages, and the bias. rows: buckets and shares of all subwords of a text."""
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    rounds = min(max(EPOCHS, -(-600 * BATCH // max(len(y), 1)) if len(y) else 0), 40)  # few rows are seen oftener
    for epoch in range(rounds):
        rate = np.float32(RATE * (1 - epoch / (rounds + 1)))
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            some = order[i : i + BATCH]
            used, n = _dense([rows[j] for j in some])
            mean = n @ table[used]
            gap = _softmax(mean @ weights + bias)
            gap[np.arange(len(some)), y[some]] -= 1
            gap /= len(some)
            back = gap @ weights.T
            weights -= rate * (mean.T @ gap)
            bias -= rate * gap.sum(axis=0)
            table[used] -= rate * 100 * (n.T @ back)  # a subword is one of very many in its text
    return table @ weights, bias


def train(docs: DataFrame) -> Model:
    """The model of `docs` (doc_id, text, lang); ids whose crc32 leaves 1 modulo 3 are held out."""
    rows = _sample(docs)
    languages = sorted(set(rows["lang"]))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    texts = [(np.frombuffer(a, "<u2"), np.frombuffer(b, "<f4")) for a, b in zip(rows["buckets"], rows["shares"], strict=True)]
    y = np.array([languages.index(x) for x in rows["lang"]])
    held = np.arange(len(y)) % 5 == 4
    if not held.any():
        held = np.ones(len(y), bool)
    learned = ~held if (~held).any() else held
    logits, bias = descend([texts[i] for i in np.flatnonzero(learned)], y[learned], len(languages))
    z = means(logits, [texts[i] for i in np.flatnonzero(held)]) + bias
    scales = np.exp(np.linspace(-2, 2, 41))
    loss = [-np.log(_softmax(z * s)[np.arange(len(z)), y[held]] + 1e-9).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = _softmax(z * scale)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    least = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(languages, logits.astype(np.float32), bias, scale, 0.0 if good.all() else least)


def classify(model: Model, text: str | None) -> tuple[str, float]:
    """The language of a whole text, and its calibrated probability."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    raw = text.encode("utf-8", "replace")
    total, n = np.zeros(len(model.languages)), 0
    for i in range(0, len(raw), PIECE):
        grams = subwords(raw[i : i + PIECE + 3])
        total += model.logits[grams].sum(axis=0, dtype=np.float64)
        n += len(grams)
    p = _softmax(((total / max(n, 1)) + model.bias)[None] * model.scale)[0]
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs` (doc_id, text, lang)."""
    model = model or train(docs)

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([classify(model, t) for t in texts], columns=["lang_pred", "score"])

    out = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), guess("text").alias("g"))
    out = out.select("doc_id", "held_out", "g.lang_pred", "g.score")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.least))
