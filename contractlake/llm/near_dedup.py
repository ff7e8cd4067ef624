"""Near-duplicate documents: SetSketch registers, bands of them as keys, exact checks, components.

1. One pass over the texts gives each row its shingle set's size, a digest of the set (equal sets
   are one class from here on, so copies are never compared) and its registers.
2. Every band of registers is a key. In each key with several classes, `HUBS` of them are paired with
   all its classes: a number of pairs in proportion to the members. Classes are hubs by one order of
   all, so that near copies, which share many keys, meet the same hub in most of them.
3. Pairs whose sizes or registers (joint likelihood) rule out the threshold go; for the others both
   whole shingle sets are intersected. Links give components.
4. Keys that still hold several components follow, pairs within a component left out. The members of
   small keys come together with their registers, and pairs these do not rule out go to step 3; the members of large ones are cut into blocks, and any two blocks of a key
   are intersected as a product of membership matrices, which returns links but no pairs.

A pair at similarity 0.75 shares no key with a probability of about 3e-6, and is ruled out by its
registers (five standard deviations) with less.

Documents with fewer words than a shingle are one shingle; those without words, or with null text,
have no shingle, are linked with nothing and stay. Repeated rows are one class. Null ids take part,
but never name a component that has another id. Empty tables give empty results. Of very long texts a
task holds the text and its set; blocks are cut by the summed sizes of their sets. Other columns than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlake.llm import sketch
from contractlake.llm.common import stage
from contractlake.llm.components import components

#: Linked where 100 * intersection >= PERCENT * union; estimates below PERCENT - SLACK are ruled out.
PERCENT, SLACK, HUBS = 75, 20, 1
#: Members of a key up to which pairs are made one by one; members of a block of larger keys, and their shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 19
BANDS = sketch.REGISTERS // sketch.BAND


def row_print():
    """Names a row by its id and text; only ever compared together with the id."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp, cls (digest of the shingle set; null if empty), n_shingles, regs for each row of `docs` (doc_id, text)."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, regs = [], [], []
            for x in batch.column(2):
                found = sketch.shingles(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64)
                n.append(len(found))
                cls.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                regs.append(sketch.registers([found])[0].tobytes() if len(found) else None)
            arrays = [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "cls", "n_shingles", "regs"])

    rows = docs.select("doc_id", row_print().alias("fp"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, cls binary, n_shingles long, regs binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """band key, cls, n for each band of each class."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    cut = F.expr(f"substring(regs, band * {sketch.BAND} + 1, {sketch.BAND})")
    return classes.select("cls", "n", "regs", band).select(F.xxhash64("band", cut).alias("key"), "cls", "n")


def _comparable(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that their registers do not rule out."""

    @F.pandas_udf("boolean")
    def likely(regs_a, regs_b, n_a, n_b):
        if not len(regs_a):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(r), np.uint8).reshape(len(r), -1) for r in (regs_a, regs_b))
        out = np.concatenate([
            sketch.similarity(a[i : i + 4096], b[i : i + 4096], n_a.to_numpy(float)[i : i + 4096], n_b.to_numpy(float)[i : i + 4096])
            for i in range(0, len(a), 4096)
        ])
        return pd.Series(out * 100 >= PERCENT - SLACK)

    left = classes.select(F.col("cls").alias("a"), F.col("regs").alias("regs_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("regs").alias("regs_b"))
    return pairs.join(left, "a").join(right, "b").filter(likely("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, members (the whole shingle set) of the wanted classes, from the text of one row of each."""
    stand = classes.join(wanted, "cls", "left_semi").select("cls", F.col("stand.doc_id").alias("stand_id"), F.col("stand.fp").alias("fp"))
    texts = docs.select("doc_id", row_print().alias("fp"), F.col("text").cast("binary").alias("text"))
    found = texts.join(stand, (texts["fp"] == stand["fp"]) & texts["doc_id"].eqNullSafe(stand["stand_id"])).select("cls", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sketch.shingles(x.as_buffer().to_pybytes()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "members"])

    # Repeated rows that stand for one class bring its set twice.
    return stage(found.mapInArrow(gather, "cls binary, members array<long>").dropDuplicates(["cls"]), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold, as (u, v)."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(check, "u binary, v binary")


def _classes_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def _small_pairs(open_keys: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a key of at most SMALL members and that their registers do not rule out.

    The members of such a key, at most SMALL, come together with their registers; only pairs that may be links leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[bytes, bytes]] = set()
            for members in batch.column(0):
                names, n, roots, regs = (members.values.field(k) for k in range(4))
                n, names, roots = n.to_numpy().astype(float), names.to_pylist(), roots.to_pylist()
                regs = np.frombuffer(b"".join(regs.to_pylist()), np.uint8).reshape(len(n), -1)
                _, root = np.unique(np.array(roots, object), return_inverse=True)
                i, j = np.triu_indices(len(n), 1)
                fit = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * PERCENT)
                i, j = i[fit], j[fit]
                if len(i):
                    near = sketch.similarity(regs[i], regs[j], n[i], n[j]) * 100 >= PERCENT - SLACK
                    out.update((min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    rows = open_keys.join(classes.select("cls", "regs"), "cls")
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("cls", "n", "root", "regs")).alias("members"))
    return lists.select("members").mapInArrow(run, "a binary, b binary").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of their membership matrices, some shingles at a time."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    places = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (left, right)]
    for at in range(0, len(both), chunk):
        mats = []
        for side in places:
            m = np.zeros((len(side), min(chunk, len(both) - at)), np.float32)
            for i, p in enumerate(side):
                m[i, p[(p >= at) & (p < at + chunk)] - at] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _block_links(open_keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of classes in different components that share a key of more than SMALL members (key, in_key, cls, n, root).

    The members of a key fall into blocks of about BLOCK sets and BLOCK_SHINGLES shingles at most; two
    blocks of one key meet in one task, which intersects all their sets at once and returns links that
    join components, never pairs. The memory of a task is that of two blocks, whatever the size of the key.
    """
    blocks = F.ceil(F.greatest(F.col("in_key") / BLOCK, F.col("shingles_in_key") / BLOCK_SHINGLES)).cast("long")
    rows = open_keys.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb"))).join(sets, "cls")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", F.col("members").alias("shingle_set"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group["own"].to_numpy() == group["own"].min()
        a, b = group[first], group[~first] if not first.all() else group[first]
        out: list[tuple[bytes, bytes]] = []
        if a["root"].nunique() + b["root"].nunique() > 1:
            x, y = ([np.asarray(s) for s in side["shingle_set"]] for side in (a, b))
            shared = shared_counts(x, y)
            size_x, size_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            linked = 100.0 * shared >= PERCENT * (size_x[:, None] + size_y[None, :] - shared).astype(float)
            names_x, names_y, roots_x, roots_y = (side[c].tolist() for c in ("cls", "root") for side in (a, b))
            joined: dict[bytes, bytes] = {}

            def top(r: bytes) -> bytes:
                while r in joined:
                    r = joined[r]
                return r

            for i, j in zip(*np.nonzero(linked), strict=True):
                if roots_x[i] != roots_y[j] and (r := top(roots_x[i])) != (q := top(roots_y[j])):
                    joined[r] = q
                    out.append((names_x[i], names_y[j]))
        return pd.DataFrame(out, columns=["u", "v"])

    return rows.groupBy("key", "i", "j").applyInPandas(run, "u binary, v binary")


def link_classes(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links found (u, v) and the components (u, root) of the classes that have one."""
    rows = band_rows(classes)
    # Bands in which a class is alone go before anything else is done with them.
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    members = stage(rows.join(shared, "key"), "near-members")
    order = F.struct(F.xxhash64("cls").alias("h"), "cls", "n")
    group = F.pmod(F.xxhash64("cls"), F.lit(HUBS))
    hubs = members.groupBy("key").agg(*[F.min(F.when(group == k, order)).alias(f"h{k}") for k in range(HUBS)])
    hubs = hubs.select("key", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hub")).filter("hub is not null")
    hubs = hubs.select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("n_hub"))
    star = members.join(hubs, "key").filter((F.col("cls") != F.col("hub")) & _comparable("n", "n_hub"))
    star = star.select(
        F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"),
        F.when(F.col("cls") < F.col("hub"), F.col("n")).otherwise(F.col("n_hub")).alias("n_a"),
        F.when(F.col("cls") < F.col("hub"), F.col("n_hub")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()
    compared = stage(star, "near-pairs")
    likely = stage(_likely(compared, classes), "near-likely")
    links = stage(_verified(likely, _sets(_classes_in(likely), classes, docs)), "near-links")
    roots = stage(components(links), "near-roots")
    # What is left: classes that share a key with another component, of whose pairs the hubs settled some only.
    placed = members.join(roots.withColumnRenamed("u", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("in_key"), F.sum("n").alias("shingles_in_key"))
    open_keys = stage(placed.join(several.filter("lo < hi and in_key > 2").select("key", "in_key", "shingles_in_key"), "key"), "near-open")
    small, large = open_keys.filter(F.col("in_key") <= SMALL), open_keys.filter(F.col("in_key") > SMALL)
    rest = stage(_small_pairs(small, classes).join(compared.select("a", "b"), ["a", "b"], "left_anti"), "near-rest")
    sets = _sets(_classes_in(rest).union(large.select("cls").distinct()).distinct(), classes, docs)
    links = stage(links.union(_verified(rest, sets)).union(_block_links(large, sets)), "near-links")
    return links, stage(components(links), "near-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = stage(sketches(docs), "near-sketches")
    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.max("n_shingles").alias("n"), F.max("regs").alias("regs"), F.min(F.struct("doc_id", "fp")).alias("stand"), F.min("doc_id").alias("least_id")
    )
    classes = stage(classes, "near-classes")
    _, roots = link_classes(docs, classes)
    placed = classes.select("cls", "least_id").join(roots.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("cls", "component_id")
    lone = rows.filter("cls is null").select("doc_id", "fp", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = rows.filter("cls is not null").join(named, "cls").select("doc_id", "fp", "n_shingles", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns; where rows share the least id, each different text of it stays."""
    stays = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct()
    out = docs.join(stays, docs["doc_id"].eqNullSafe(F.col("__id")) & (row_print() == F.col("__fp")), "left_semi")
    return out
