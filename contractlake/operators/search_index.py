"""A stored keyword index with block bounds: built once, searched by many queries.

Chunks are dealt into slots of about `SLOT` by a hash of their key. A block holds the postings of one term in one slot: keys in order, the first and how far
the others are from it (numeric keys), with counts and lengths, and the greatest weight among them. A slot's bound for a query is the sum, over the query's terms, of
idf times that weight; only slots whose bound reaches the query's k-th best score are opened. A first search of each query's most promising slots
gives a score that the k-th best can't fall below. Scores are BM25; negative ones are handled: a term of negative idf adds nothing to a bound.
Runs of slots meet batches of queries in groups, where the postings of a slot and the weights of the queries that open it make one matrix product;
only the k best of each query leave a group, so no posting becomes a row.

    <path>/docs     key, slot, dl, terms (array of struct<term, tf>): each text is tokenised once
    <path>/blocks   term, slot, n, most, keys, tfs, dls
    <path>/terms    term, df, idf          <path>/stats   n, avgdl, k1, b, one row
    <path>/places   key, at                the keys in order
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contractlake.functions import columns as C
from contractlake.session import staged

#: Chunks a slot; slots of each query that are searched first.
SLOT, FIRST = 64, 8
#: Slots of a run and queries of a batch, which meet in one group; most tasks that groups are dealt into.
RUN, BATCH, TASKS = 8, 256, 2_000
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


class Index(NamedTuple):
    key: str
    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    places: DataFrame


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of a row's tokens: sorted, so that equal ones make a run."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, i: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(t)) - at).alias("tf"))))[0]

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) == 0, empty).otherwise(F.transform(F.array(F.array_sort(tokens)), runs)[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, slot, number of tokens and `term_counts` of texts in lower case, a few rows at a time."""
    find = re.compile("[a-z0-9]+").findall
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            found = [find(t) for t in batch.column(2).to_pylist()]
            counts = [sorted(Counter(t).items()) for t in found]
            ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            pairs = [p for c in counts for p in c]
            entry = pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())], ["term", "tf"])
            terms = pa.ListArray.from_arrays(pa.array(ends), entry)
            dl = pa.array(list(map(len, found)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dl, terms], [*batch.schema.names[:2], "dl", "terms"])


def _weight(tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    """A posting's share of a score, but for the idf: grows with tf, falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _entries(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a column of lists, and the entries."""
    lists = pa.concat_arrays(lists.chunks)
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _blocks_of(key: str, kind: str, avgdl: float, k1: float, b: float):
    """The function that makes the blocks of one slot from its rows of docs."""

    def blocks(docs: pa.Table) -> pa.Table:
        docs = docs.sort_by(key)
        row, entry = _entries(docs["terms"])
        terms = entry.field("term").dictionary_encode()
        code = _numbers(terms.indices)
        order = np.argsort(code, kind="stable")  # rows ascend by key, so a term's do
        code, row, tf = code[order], row[order], _numbers(entry.field("tf"))[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        sizes = np.diff(starts, append=len(code))
        dl = _numbers(docs["dl"])[row]
        keys = pa.concat_arrays(docs[key].chunks).take(pa.array(row))
        if kind in _INTEGRAL:
            far = _numbers(keys).copy()
            first = np.repeat(far[starts], sizes)
            first[starts] = 0
            keys = pa.array(far - first, keys.type)
        most = np.maximum.reduceat(_weight(tf, dl, avgdl, k1, b), starts) if len(starts) else np.zeros(0)
        offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys, pa.array(tf, pa.int32()), pa.array(dl, pa.int32()))]
        slot = pa.array(np.full(len(starts), docs["slot"][0].as_py()), pa.int32())
        columns = [terms.dictionary.take(pa.array(code[starts])), slot, pa.array(sizes, pa.int32()), pa.array(most), *lists]
        return pa.Table.from_arrays(columns, ["term", "slot", "n", "most", "keys", "tfs", "dls"])

    return blocks


def build(chunks: DataFrame, path: str, *, key: str = "chunk_id", slot: int = SLOT, epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> Index:
    """Writes the index of `chunks` (key, text) to `path`. Negative idf becomes `epsilon` times the mean idf; keys are unique."""
    spark = chunks.sparkSession
    slots = max(1, -(-chunks.count() // slot))
    slotted = chunks.select(key, F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    schema = StructType([*slotted.schema.fields[:2], *StructType.fromDDL("dl int, terms array<struct<term: string, tf: int>>").fields])
    slotted.mapInArrow(_counted, schema).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).select("n", "avgdl", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
    stats.coalesce(1).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    # Whole rows are dealt by slot; a slot's postings never leave it, and no term gathers anywhere.
    kind, one = dict(docs.dtypes)[key], stats.first()
    make = _blocks_of(key, kind, one["avgdl"], one["k1"], one["b"])
    blocks = docs.groupBy("slot").applyInArrow(make, f"term string, slot int, n int, most double, keys array<{kind}>, tfs array<int>, dls array<int>")
    blocks.sortWithinPartitions("term", "slot").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    raw = blocks.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats.select("n")))
    raw = raw.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf")).write.parquet(f"{path}/terms")
    docs.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{path}/places")
    return open_index(spark, path, key=key)


def open_index(spark: SparkSession, path: str, *, key: str = "chunk_id") -> Index:
    return Index(key, *(spark.read.parquet(f"{path}/{name}") for name in ("docs", "blocks", "terms", "stats", "places")))


def asked_terms(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, weight: repeated terms of a query count as often as they occur; terms that no chunk holds are left out."""
    asked = queries.select("query_id", F.explode(term_counts(C.tokens(F.col("query")))).alias("t")).select("query_id", "t.term", "t.tf")
    asked = asked.groupBy("query_id", "term").agg(F.sum("tf").alias("qtf"))
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def slot_bounds(asked: DataFrame, index: Index) -> DataFrame:
    """query_id, slot, bound: what no chunk of the slot can exceed. Reads three columns of the blocks, no posting."""
    bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most"))
    return index.blocks.select("term", "slot", "most").join(asked, "term").groupBy("query_id", "slot").agg(bound.alias("bound"))


def postings(index: Index, blocks: DataFrame | None = None) -> DataFrame:
    """The other columns of the blocks (all of the index, where none are given) with key, tf, dl of each posting."""
    blocks = index.blocks.select("term", "slot", "keys", "tfs", "dls") if blocks is None else blocks
    kind, keys = dict(index.docs.dtypes)[index.key], F.col("keys")
    if kind in _INTEGRAL:
        keys = F.transform("keys", lambda x, i: F.when(i == 0, x).otherwise(x + F.get("keys", F.lit(0))))
    rest = [c for c in blocks.columns if c not in ("keys", "tfs", "dls")]
    rows = blocks.select(*rest, F.explode(F.arrays_zip(keys.alias("key"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("p"))
    return rows.select(*rest, F.col("p.key").cast(kind).alias(index.key), "p.tf", "p.dl")


def _scores_of(key: str, kind: str, k: int | None, digits: int | None, avgdl: float, k1: float, b: float):
    """The function that scores a run of slots for a batch of queries: all chunks that share a term, or the k best of each query."""

    def scores(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        ids, terms = pa.concat_arrays(queries["query_id"].chunks or [pa.nulls(0)]), pa.concat_arrays(blocks["term"].chunks or [pa.nulls(0)])
        found_key, found_query, found = [], [], []
        if len(ids) and len(terms):
            vocabulary = terms.unique()
            code, slots = _numbers(terms.dictionary_encode().indices), _numbers(blocks["slot"])
            row, key_of = _entries(blocks["keys"])
            if kind in _INTEGRAL:
                far = _numbers(key_of).copy()
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                first = np.repeat(far[starts], np.diff(starts, append=len(row)))
                first[starts] = 0
                key_of = pa.array(far + first, key_of.type)
            weight = _weight(*(_numbers(_entries(blocks[c])[1]).astype(float) for c in ("tfs", "dls")), avgdl, k1, b)
            query, entry = _entries(queries["terms"])
            asked = _numbers(pc.fill_null(pc.index_in(entry.field("term"), vocabulary), -1))
            query, entry_weight, asked = query[asked >= 0], _numbers(entry.field("weight"))[asked >= 0], asked[asked >= 0]
            opener, opened = _entries(queries["slots"])
            opened = _numbers(opened)
            of_slot = slots[row]
            for slot in np.unique(opened):
                here, open_ = np.flatnonzero(of_slot == slot), np.unique(opener[opened == slot])
                if not len(here):
                    continue
                chunks = key_of.take(pa.array(here)).dictionary_encode()
                held, term = np.unique(code[row[here]], return_inverse=True)
                place, column = np.full(len(vocabulary), -1), np.full(len(ids), -1)
                place[held], column[open_] = np.arange(len(held)), np.arange(len(open_))
                meet = (place[asked] >= 0) & (column[query] >= 0)
                left, right = np.zeros((len(chunks.dictionary), len(held))), np.zeros((len(held), len(open_)))
                left[_numbers(chunks.indices), term] = weight[here]
                at = place[asked[meet]], column[query[meet]]
                right[at] = entry_weight[meet]
                there = np.zeros(right.shape, np.float32)
                there[at] = 1
                i, j = np.nonzero((left > 0).astype(np.float32) @ there)
                found_key.append(chunks.dictionary.take(pa.array(i)))
                found_query.append(open_[j])
                found.append((left @ right)[i, j])
        if not found:
            return pa.Table.from_arrays([queries["query_id"].slice(0, 0), blocks["keys"].slice(0, 0).combine_chunks().flatten(), pa.array([], pa.float64())], ["query_id", key, "score"])
        keys, query, score = pa.concat_arrays(found_key), np.concatenate(found_query), np.concatenate(found)
        if digits is not None:
            score = np.copysign(np.floor(np.abs(score) * 10.0**digits + 0.5), score) / 10.0**digits + 0.0
        if k is not None:
            order = np.lexsort((np.argsort(_numbers(pc.sort_indices(keys))), -score, query))
            query = query[order]
            order = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
            keys, query, score = keys.take(pa.array(order)), np.concatenate(found_query)[order], score[order]
        return pa.Table.from_arrays([ids.take(pa.array(query)), keys, pa.array(score)], ["query_id", key, "score"])

    return scores


def slot_scores(asked: DataFrame, slots: DataFrame, index: Index, k: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, key, score of the chunks that share a term with the query, in the slots (query_id, slot) given.

    With `k` each group of slots gives no more than the k best of a query, ties to the smaller key.
    """
    one, key, kind = index.stats.first(), index.key, dict(index.docs.dtypes)[index.key]
    runs = max(1, -(-one["n"] // (SLOT * RUN)))
    batches = max(1, -(-asked.select("query_id").distinct().count() // BATCH))
    run = F.pmod(F.col("slot"), F.lit(runs)).alias("run")
    terms = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    openers = slots.select("query_id", run, "slot").groupBy("query_id", "run").agg(F.collect_list("slot").alias("slots")).join(terms, "query_id")
    openers = openers.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int"))
    blocks = index.blocks.select("term", "slot", run, "keys", "tfs", "dls").join(asked.select("term").distinct(), "term", "left_semi")
    blocks = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    # Dealt by number: blocks are small for the work that they make, and adaptive execution would put them into one task.
    keys, tasks = ("run", "batch"), min(TASKS, runs * batches)
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (blocks, openers))
    score = _scores_of(key, kind, k, digits, one["avgdl"], one["k1"], one["b"])
    return left.cogroup(right).applyInArrow(score, f"query_id {dict(asked.dtypes)['query_id']}, {key} {kind}, score double")


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def open_slots(asked: DataFrame, index: Index, k: int, *, digits: int | None = None, first: int = FIRST) -> DataFrame:
    """query_id, slot, bound, opened: every slot that shares a term with a query, and whether its bound reaches the score to beat."""
    bounds = staged(slot_bounds(asked, index), "bounds")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "slot"))
    early = bounds.withColumn("turn", turn).filter(F.col("turn") <= first)
    known = _best(slot_scores(asked, early, index, k), k, index.key).filter(F.col("rank") == k).select("query_id", F.col("score").alias("to_beat"))
    margin = 1e-9 if digits is None else 1.5 * 10.0**-digits  # scores that round to the same tie
    return bounds.join(known, "query_id", "left").select("query_id", "slot", "bound", (F.col("to_beat").isNull() | (F.col("bound") >= F.col("to_beat") - margin)).alias("opened"))


def search(queries: DataFrame, index: Index, k: int, *, digits: int | None = None, zero_rows: bool = False, first: int = FIRST) -> DataFrame:
    """query_id, key, score, rank: the k best chunks of each query (query_id, query), ties to the smaller key.

    With `zero_rows` chunks that share no term count 0 and fill up, by key; those of negative score stand behind them.
    """
    asked, key = staged(asked_terms(queries, index), "asked-terms"), index.key
    slots = staged(open_slots(asked, index, k, digits=digits, first=first), "open-slots")
    best = staged(_best(slot_scores(asked, slots.filter("opened"), index, k, digits), k, key), "best")
    if not zero_rows:
        return best
    above = best.filter("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("above"))
    short = staged(queries.select("query_id").distinct().join(above, "query_id", "left").filter(F.coalesce("above", F.lit(0)) < k).select("query_id"), "short")
    if short.isEmpty():
        return best
    few = lambda df: df.join(short, "query_id", "left_semi")
    scored = staged(slot_scores(few(asked), few(slots), index, None, digits), "short-scores")
    # Among the first m + k keys at least k share no term with a query of m hits: as many keys a query as it has hits, no more.
    counts = short.join(scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
    wanted = counts.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)) + F.lit(k - 1))).alias("place"))
    fillers = wanted.join(_places(index), "place").select("query_id", key).join(scored.select("query_id", key), ["query_id", key], "left_anti")
    filled = _best(scored.unionByName(fillers.withColumn("score", F.lit(0.0))), k, key)
    return best.join(short, "query_id", "left_anti").unionByName(filled.select(best.columns))


def _places(index: Index) -> DataFrame:
    """key, place: the number of each key, from 0, in order. A table of one row a file tells how many come before."""
    part = F.shiftright("at", 33)
    sizes = index.places.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("from"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("rows").over(W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return index.places.withColumn("part", part).join(sizes, "part").select(index.key, (F.col("before") + F.col("at") - F.col("from")).alias("place"))
