"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over the training run, given as knots of a piecewise-linear
curve. The integral of the schedule is the source's share of all words demanded; where a share
is larger than the source may give (`max_repeats` times its words), it stops there and the rest
is reshared by weight. Within a source the documents stand in the order of a hash of their id;
a document's place in the cumulative words, over the source's target, is inverted through the
schedule's integral to give its training position in [0, 1), and documents are range-sorted by it.

Null sources are one source, ordered last. Null texts have size 0. Repeated rows count as often
as they occur. An empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.llm.common import stage, word_count

#: Hex digits of the id's hash that name a bucket: 16 ** 3 buckets a source, each summed on its own.
BUCKET_DIGITS = 3


def ramps(weight: Column, rank: Column) -> Column:
    """The default curriculum: sources of even rank fade from 1.5 to 0.5 times their weight, odd ones rise; either integrates to the weight."""
    early, late = F.when(rank % 2 == 0, 1.5).otherwise(0.5), F.when(rank % 2 == 0, 0.5).otherwise(1.5)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), (w * weight).alias("w"))
    return F.array(knot(0.0, early), knot(1.0, late))


def integrate(knots: Column) -> Column:
    """Cumulative integral at each knot of a piecewise-linear schedule."""
    areas = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: (knots[i]["t"] - knots[i - 1]["t"]) * (knots[i]["w"] + knots[i - 1]["w"]) / 2,
    )
    return F.aggregate(areas, F.array(F.lit(0.0)), lambda done, a: F.concat(done, F.array(F.element_at(done, -1) + a)))


def invert(knots: Column, areas: Column, share: Column) -> Column:
    """The time at which `share` (0 to 1) of the schedule's integral has passed."""
    goal = share * F.element_at(areas, -1)
    i = F.least(F.greatest(F.size(F.filter(areas, lambda a: a <= goal)), F.lit(1)), F.size(areas) - 1)
    left, right = F.element_at(knots, i), F.element_at(knots, i + 1)
    rest, span = goal - F.element_at(areas, i), right["t"] - left["t"]
    slope = (right["w"] - left["w"]) / span
    root = F.sqrt(F.greatest(left["w"] * left["w"] + 2 * slope * rest, F.lit(0.0)))
    return left["t"] + F.when(rest <= 0, 0.0).otherwise(F.least(span, F.try_divide(2 * rest, left["w"] + root)))


def fill_targets(sources: DataFrame, share: float, max_repeats: float) -> DataFrame:
    """Adds `target` to (source, source_size, rank, weight): demand by weight, none above `max_repeats` times its size.

    Sources in ascending order of cap over weight reach their cap one after the other; the level at
    which the first one does not is the level of all that follow. One row a source: the windows
    without a partition run over the list of sources, never over documents.
    """
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = sources.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    s = s.withColumn("demand", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("demand") - F.col("cap_before")) / F.col("weight_from"))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    s = s.withColumn("common", F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy()))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("common"))).drop(
        "cap", "demand", "cap_before", "weight_from", "level", "capped", "common"
    )


def row_print() -> Column:
    """Names a row by its id, source and text; only ever compared together with the id."""
    return F.xxhash64("doc_id", "source", "text")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeats: int = 2,
    schedule=ramps,
) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text), range-sorted by training position.

    `weights` go to the sources by code point, repeating; `schedule(weight, rank)` gives a source's
    knots. Columns: doc_id, size, source_size, target, taken, position (of its first words; those
    of which nothing is taken stand after 1), passes (array of struct<words, position>, one each
    time the mix reads the document; the last pass may read only its head), fp (names the row).
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), row_print().alias("fp"))
    sizes = stage(sizes.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "mix-sizes")
    buckets = stage(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = fill_targets(sources.withColumn("weight", pick[F.col("rank") % len(weights)]), share, max_repeats)
    sources = sources.withColumn("knots", schedule(F.col("weight"), F.col("rank")))
    sources = sources.withColumn("areas", integrate(F.col("knots")))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    starts = starts.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        "b.source", "b.bucket", "base", "source_size", "target", "knots", "areas"
    )
    place = W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("inner", F.coalesce(F.sum("size").over(place), F.lit(0)))
    rows = rows.alias("r").join(
        starts.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))
    )
    start, quota = F.col("base") + F.col("inner"), F.floor("target")
    rows = rows.select("doc_id", "fp", "size", "source_size", "target", "key", start.alias("start"), quota.alias("quota"), "knots", "areas")

    def reading(k: Column) -> Column:
        at = k * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - at)).cast("long")
        when = invert(F.col("knots"), F.col("areas"), F.try_divide(at, F.col("quota")))
        return F.struct(words.alias("words"), F.round(when, 9).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), reading), lambda p: p["words"] > 0)
    rows = rows.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    left_out = 1 + F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12)
    rows = rows.withColumn("taken", taken).withColumn("position", F.coalesce(F.try_element_at("passes", F.lit(1))["position"], F.round(left_out, 9)))
    out = rows.select("doc_id", "fp", "size", "source_size", "target", "taken", "position", "passes")
    return out.repartitionByRange("position").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix reads any of it, in the order of their positions.

    Documents that the mix does not reach are left out; one whose last reading is of its head only
    counts as read whole.
    """
    plan = mix(docs, **how).filter("taken > 0").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "passes")
    plan = stage(plan, "mix-plan")
    keyed = docs.withColumn("__print", row_print())
    per_row = plan.groupBy("__id", "__fp").agg(F.flatten(F.collect_list("passes")).alias("__passes"), F.count(F.lit(1)).alias("__rows"))
    if not per_row.filter("__rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__print", "doc_id"])  # the repeated rows' readings are all in one
    joined = keyed.join(per_row, (F.col("__print") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    read = joined.withColumn("__at", F.explode("__passes"))
    return read.repartitionByRange(F.col("__at.position")).sortWithinPartitions("__at.position", "doc_id").select(*docs.columns)
