"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, its closeness to words of the second person,
capitals, punctuation, and rates of obfuscated spellings. The lexicon (words, and word beginnings
for inflected forms) is learned from the labelled rows, too: terms that occur far oftener in texts
with label 1. Model and lexicon are fitted on at most `SAMPLE_ROWS` labelled rows, those with the
smallest hash of their id; all texts are scored, each whole.

Null texts count as empty. Repeated rows get equal scores; an id that labels or documents repeat is learned from once: as toxic if
any of its labels says so, by the first of its texts in byte order. Equal hashes are ordered by the id. Labels that are null, or whose document
is missing, are not used; without labels of both kinds every score is the share of label 1 (0 if
there are no labels). Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.llm import boosting
from contractlake.llm.common import remainder, stage

#: Labelled rows that lexicon and model are fitted on; texts with label 1 that a term needs, and its least log-likelihood ratio:
#: by chance, one of some hundred thousand terms reaches it.
SAMPLE_ROWS, LEAST_TEXTS, LEAST_RATIO = 8_000, 4, 24.0
#: A text is predicted toxic from this score on.
THRESHOLD = 0.3
#: Lengths in bytes of the word beginnings that the lexicon may hold; words around a hit that count as near.
STEMS, NEAR = (4, 5, 6, 7, 8), 5
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    x.encode()
    for x in (
        "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos"
        " tú ti tus usted ustedes vosotros vuestro"
    ).split()
)

_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_WORDS = bytes.maketrans(
    bytes(range(65, 91)) + _PUNCTUATION + b"0123456789", bytes(range(97, 123)) + b" " * len(_PUNCTUATION) + b" " * 10
)
_LETTERS_FOR = bytes.maketrans(b"013457@$!|", b"oieastasil")
#: Begins where a run of such characters begins and gives nothing back, so that unbroken runs are read once.
_hidden = re.compile(rb"(?<![A-Za-z0-9@$!|*_.\-])[A-Za-z]*+(?:[0-9@$!|*_.\-]++[A-Za-z]++)+")
_spelled = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z][ .\-]){3,}[A-Za-z](?![A-Za-z])")
_capitals = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
_runs = re.compile(rb"([!?*#$%&])\1")
N_FEATURES = 22
#: Words whose weight a worker remembers before it starts afresh.
CACHE_WORDS = 300_000


class Model(NamedTuple):
    lexicon: dict[bytes, float]
    trees: boosting.Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; punctuation and digits part them."""
    return raw.translate(_WORDS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, as the lexicon names them: a beginning ends in '*'."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


class Featurizer:
    """Features of one text after the other; remembers the weights of words."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon, self.cache = lexicon, {}

    def weight(self, word: bytes) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return found

    def __call__(self, raw: bytes) -> list[float]:
        words = words_of(raw)
        n, size = len(words), max(len(raw), 1)
        counts = Counter(words)
        hits = {w: x for w in counts if (x := self.weight(w)) > 0}
        n_hits = sum(counts[w] for w in hits)
        weighted = sum(counts[w] * x for w, x in hits.items())
        second = sum(counts[w] for w in SECOND_PERSON & counts.keys())
        near = 0
        if hits and second:
            at = np.array([i for i, w in enumerate(words) if w in hits])
            you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
            right = np.minimum(np.searchsorted(you, at), len(you) - 1)
            near = int((np.minimum(abs(you[right] - at), abs(you[np.maximum(right - 1, 0)] - at)) <= NEAR).sum())
        hidden = _hidden.findall(raw)
        obscured = [x.translate(_LETTERS_FOR, b"*_.-").lower() for x in hidden]
        obscured += [bytes(b for b in x if 65 <= b & 223 <= 90).lower() for x in _spelled.findall(raw)]
        masked = [w for w in obscured if self.weight(w) > 0]
        length = max(n, 1)
        upper = len(raw) - len(raw.translate(None, _UPPER))
        punctuation = size - len(raw.translate(None, _PUNCTUATION)) if raw else 0
        return [
            np.log1p(n), n_hits, np.log1p(n_hits), n_hits / length, weighted / length, weighted,
            max(hits.values(), default=0.0), len(hits), len(masked), len(masked) / length, len(hidden) / length,
            second / length, near, near / length, upper / size, len(_capitals.findall(raw)) / length,
            raw.count(b"!") / length, raw.count(b"?") / length, punctuation / size, len(_runs.findall(raw)) / length,
            sum(map(len, words)) / length, len(counts) / length,
        ]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part (0 to 99) of the labelled rows that are fitted on."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    # One row an id before the limit, one text an id after the join: repeats of an id neither crowd out others nor pass the bound.
    chosen = usable.filter(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("h", "doc_id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS narrow rows: safe to broadcast at any size of the input.
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "h").agg(F.min("raw").alias("raw"))
    return stage(rows.select("raw", "toxic", F.pmod("h", F.lit(100)).cast("int").alias("part")), "toxicity-sample")


def _term_counts(rows: DataFrame, among: frozenset[bytes] | None) -> DataFrame:
    """term, n: texts that hold each term, summed within each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for raw in batch["raw"]:
                terms = {t for w in set(words_of(bytes(raw or b""))) for t in terms_of(w)}
                found.update(terms if among is None else terms & among)
            if len(found) > 500_000:
                yield pd.DataFrame({"term": list(found), "n": list(found.values())})
                found.clear()
        yield pd.DataFrame({"term": list(found), "n": list(found.values())}, columns=["term", "n"])

    return rows.select("raw").mapInPandas(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Terms of the sample with their log odds: all that occur far oftener in texts with label 1."""
    n_bad, n_good = (sample.filter(F.col("toxic") == k).count() for k in (1, 0))
    if not n_bad or not n_good:
        return {}
    frequent = _term_counts(sample.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_TEXTS)
    bad = {bytes(r["term"]): r["n"] for r in frequent.collect()}
    good = {bytes(r["term"]): r["n"] for r in _term_counts(sample.filter("toxic = 0"), frozenset(bad)).collect()}
    share = n_bad / (n_bad + n_good)
    odds = {}
    for term, n in bad.items():
        g = good.get(term, 0)
        ratio = 2 * (n * np.log(n / ((n + g) * share)) + (g * np.log(g / ((n + g) * (1 - share))) if g else 0.0))
        log_odds = float(np.log((n + 0.5) / (n_bad + 1)) - np.log((g + 0.5) / (n_good + 1)))
        if log_odds >= 2.0 and ratio >= LEAST_RATIO:
            odds[term] = log_odds
    return {t: odds[t] for t in sorted(odds)}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of `docs` (doc_id, text) and `labels` (doc_id, toxic); ids whose crc32 leaves 2 modulo 4 are held out."""
    sample = _sample(docs, labels)
    lexicon = learn_lexicon(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Featurizer(lexicon)
        for batch in batches:
            yield pd.DataFrame({"x": [one(bytes(r or b"")) for r in batch["raw"]], "toxic": batch["toxic"], "part": batch["part"]})

    rows = sample.mapInPandas(measure, "x array<double>, toxic int, part int").toPandas()  # at most SAMPLE_ROWS short rows
    if rows["toxic"].nunique() < 2:
        return Model(lexicon, None, None, float(rows["toxic"].mean()) if len(rows) else 0.0)
    rows = rows.assign(key=[tuple(x) for x in rows["x"]]).sort_values(["part", "toxic", "key"])  # whatever order the tasks ended in
    x, y, part = np.stack(rows["x"]), rows["toxic"].to_numpy(float), rows["part"].to_numpy()
    trees = boosting.fit(x, y)
    # Calibrated on scores that each third of the rows gets from trees fitted on the others.
    unseen = np.zeros(len(y))
    for fold in range(3):
        held = part % 3 == fold
        rest = boosting.fit(x[~held], y[~held]) if len(set(y[~held])) == 2 else trees
        unseen[held] = boosting.raw_scores(rest, x[held])
    return Model(lexicon, trees, boosting.isotonic(unseen, y), float(y.mean()))


def scorer(model: Model):
    """A pandas UDF: text -> score from 0 to 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Featurizer(model.lexicon)
        for texts in parts:
            if model.trees is None or not len(texts):
                yield pd.Series(np.full(len(texts), model.rate))
                continue
            x = np.array([one(t.encode("utf-8", "replace") if t else b"") for t in texts])
            yield pd.Series(np.interp(boosting.raw_scores(model.trees, x), *model.knots))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text)."""
    score = scorer(train(docs, labels))
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    return docs.filter(_below(scorer(train(docs, labels))("text"), threshold))


def _below(score: Column, threshold: float) -> Column:
    return score < threshold
