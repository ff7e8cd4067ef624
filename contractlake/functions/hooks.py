"""Hooks for models: their Python runs on batches of rows, loaded once a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlake.functions import columns as C

#: Length of the vectors of the encoder used where none is given.
DIMENSIONS = 256


def hashed_vectors(rows: DataFrame, text: str, size: int = DIMENSIONS) -> DataFrame:
    """Adds `embedding`: term counts hashed into `size` places, of length 1 (a stand-in for a sentence encoder)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    terms = rows.withColumn("__terms", C.tokens(F.col(text)))
    counted = HashingTF(inputCol="__terms", outputCol="__counts", numFeatures=size).transform(terms)
    unit = Normalizer(inputCol="__counts", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__terms", "__counts", "__unit")


def with_embeddings(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, *, text: str = "text") -> DataFrame:
    """Adds `embedding`. `encoder()` is called once a task and gives a function of a list of texts."""
    if encoder is None:
        return hashed_vectors(rows, text)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in parts:
            yield pd.Series(list(model(texts.fillna("").tolist())), dtype=object)

    return rows.withColumn("embedding", run(text))


def pair_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """The scorer of (query, text) pairs used where no model is given: half for the share of the query's distinct terms
    that the text holds, half for the share of its distinct pairs of neighbouring terms that are neighbours there."""
    words = re.compile("[a-z0-9]+")

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for query, text in zip(queries, texts, strict=True):
            q, t = words.findall(query.lower()), words.findall(text.lower())
            terms, pairs = set(q), set(zip(q, q[1:], strict=False))
            a = len(terms & set(t)) / len(terms) if terms else 0.0
            b = len(pairs & set(zip(t, t[1:], strict=False))) / len(pairs) if pairs else 0.0
            out.append(0.5 * a + 0.5 * b)
        return out

    return score


def annotate(rows: DataFrame, annotator: Callable[[], Callable[[list[str]], list[str]]], schema: str, *, text: str = "text", name: str = "annotation") -> DataFrame:
    """Adds `name`: the annotator's JSON answer in the given schema, null where it has another shape. `annotator()` is called once a task."""
    from contractlake.operators.normalize import parsed_response

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = annotator()
        for texts in parts:
            yield pd.Series(model(texts.fillna("").tolist()), dtype=object)

    return rows.withColumn(name, parsed_response(run(text), schema))


def join_annotations(rows: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a table of answers that were computed before."""
    return rows.join(annotations, keys, "left")


def grouped(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Order-dependent logic in Python, a group at a time, its rows in order."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return fold(part.sort_values(order, kind="stable"))

    return rows.groupBy(*keys).applyInPandas(run, schema)
