"""A Merkle manifest of a dataset, with a proof for every row, by time-forward processing.

Every row is a leaf: the SHA-256 (lower-case hex) of its fields, each as `-` if null, else as its length in UTF-8
bytes, `:` and its value. The leaves of a group (language), in order, form a tree: every `ARITY` consecutive nodes
become the hash of their concatenated digests until one is left, the group's subroot; subroots, in order of their
groups (null first), form a tree in the same way, whose last node is the root.

Nodes are labelled by level and place, so that children precede their parents. A forward sweep takes nodes in the order
of their labels and sends each digest to its parent through a priority queue; what a block of `ARITY ** HEIGHT` nodes
can't finish is written out and taken up, sorted, as the leaves of the next round. A reversed sweep goes from the
root down: each node sends its children what they need of the levels above, the siblings of a path, until every leaf has
its proof. A block is one row or one group of a job, so nothing grows with the group or the table.

Rows with equal ids are all leaves, ordered by digest. A null id comes first and is never tampered with. An empty
table gives an empty result; a lone leaf is its own subroot, a lone subroot the root. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.llm.common import LOWER, UPPER, stage

#: Children of a node; levels that a block of one round spans.
ARITY, HEIGHT = 8, 4
BLOCK = ARITY**HEIGHT
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields, in the order given."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def placed(leaves: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds `place` (from 0, by `order` within its group) and `n` (rows of the group) and writes the result.

    Rows are dealt by range, sorted where they lie and numbered through; a small table of each part's groups tells how many rows come before.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lie = leaves.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    lie = stage(lie.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = lie.groupBy(part.alias("part"), F.col(group).alias("run_of")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("run_of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(W.partitionBy("run_of")))
    joined = lie.withColumn("part", part).join(runs.withColumnRenamed("part", "run_part"), (F.col("part") == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_of")))
    return joined.withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "run_part", "run_of", "first", "rows", "before")


def levels_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def sweep(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """All nodes of a block, a list a level: each node, in the order of labels, sends its digest to its parent through the queue."""
    done: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue = [(0, place, 0, d) for place, d in enumerate(digests)]  # level and place of the receiver, place of the child, what it sends
    heapq.heapify(queue)
    while queue:
        level, place, _, sent = heapq.heappop(queue)
        got = [sent]
        while level and queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        digest = hashlib.sha256("".join(x.hex() for x in got).encode()).digest() if level else got[0]
        done[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // ARITY, place % ARITY, digest))
    return done


def siblings(nodes: list[bytes], place: int) -> bytes:
    """One level of a path: how many of the run stand before the node, how many after, and their digests."""
    first = place - place % ARITY
    run = nodes[first : first + ARITY]
    at = place - first
    return bytes([at, len(run) - at - 1]) + b"".join(run[:at] + run[at + 1 :])


def paths(done: list[list[bytes]], above: bytes) -> list[bytes]:
    """What each leaf of a block needs: levels are gone through downwards, every node handing its children its own path after their siblings."""
    down = [above]
    for nodes in reversed(done[:-1]):
        down = [siblings(nodes, i) + down[i // ARITY] for i in range(len(nodes))]
    return down


def unpacked(path: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """Digests before and after the node, level by level."""
    out, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        cut = [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(left + right)]
        out.append((cut[:left], cut[left:]))
        at += 2 + 32 * (left + right)
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    for before, after in unpacked(path):
        digest = hashlib.sha256("".join(x.hex() for x in (*before, digest, *after)).encode()).digest()
    return digest


def proof_digest(path: bytes) -> str:
    """SHA-256 of the siblings as hex text, level by level, left to right."""
    return hashlib.sha256("".join(x.hex() for pair in unpacked(path) for side in pair for x in side).encode()).hexdigest()


def _round(nodes: DataFrame, group: str, kind: str, payload: list[str]) -> DataFrame:
    """One row a block of (group, place, n, digest and payload): its members as lists, its digest, and the rows of its group in the next round."""
    names = ["digest", *payload]
    types = dict(nodes.dtypes)
    schema = f"{group} {kind}, place long, n long, top binary, " + ", ".join(f"{x}s array<{types[x]}>" for x in names)

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        n = int(rows["n"].iloc[0])
        levels = min(HEIGHT, levels_of(n))
        digests = [bytes(x) for x in rows["digest"]]
        top = sweep(digests, levels)[-1][0]
        lists = {f"{x}s": [digests if x == "digest" else [None if pd.isna(v) else v for v in rows[x]]] for x in names}
        return pd.DataFrame({group: [rows[group].iloc[0]], "place": [int(rows["place"].iloc[0]) // BLOCK], "n": [-(-n // BLOCK)], "top": [top], **lists})

    return nodes.groupBy(F.col(group), F.expr(f"place div {BLOCK}")).applyInPandas(close, schema)


def forward(nodes: DataFrame, group: str, payload: list[str], name: str) -> list[DataFrame]:
    """The rounds of the forward sweep over (group, place, n, digest): tables of blocks, the last with one block a group."""
    kind, rounds = dict(nodes.dtypes)[group], []
    while True:
        blocks = stage(_round(nodes, group, kind, payload if not rounds else []), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        if blocks.filter("n > 1").isEmpty():
            return rounds
        nodes = blocks.select(group, "place", "n", F.col("top").alias("digest"))


def backward(rounds: list[DataFrame], group: str, tops: DataFrame, name: str) -> DataFrame:
    """(group, place, n, path and the columns of tops) of the blocks of the first round; tops: (group, path, ...), what the last nodes need of the levels above."""
    extra = [c for c in tops.columns if c not in (group, "path")]
    asked = tops.select(F.col(group).alias("of"), F.lit(0).cast("long").alias("at"), "path", *extra)
    for k in range(len(rounds) - 1, 0, -1):
        blocks = _met(rounds[k], group, asked, extra)
        schema = f"of {dict(tops.dtypes)[group]}, at long, path binary" + "".join(f", {c} {dict(tops.dtypes)[c]}" for c in extra)

        def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    digests = [bytes(x) for x in row["digests"]]
                    own = paths(sweep(digests, min(HEIGHT, levels_of(_below(row, len(digests))))), bytes(row["path"]))
                    first = int(row["place"]) * BLOCK
                    yield pd.DataFrame({"of": row[group], "at": range(first, first + len(own)), "path": own, **{c: row[c] for c in extra}}, columns=["of", "at", "path", *extra])

        asked = stage(blocks.mapInPandas(down, schema), f"{name}-{k}")
    return _met(rounds[0], group, asked, extra)


def _below(row: dict, members: int) -> int:
    """A number of nodes with as many levels, up to HEIGHT, as the group of this block has."""
    return members if row["n"] == 1 else BLOCK + 1


def _met(blocks: DataFrame, group: str, asked: DataFrame, extra: list[str]) -> DataFrame:
    """Blocks with the paths of their last nodes: one row meets one."""
    return blocks.join(asked, F.col(group).eqNullSafe(F.col("of")) & (F.col("place") == F.col("at"))).drop("of", "at")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs` (doc_id, source, lang, n_chars, text).

    Where 3 divides the crc32 of the decimal doc_id, the row is tampered with after the manifest is made: A-Z of its text become lower case.
    """
    docs = docs.select(*FIELDS)
    plain = [F.col(c) for c in FIELDS]
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    own = F.unhex(leaf_digest(plain))
    leaves = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", own.alias("digest"), F.when(tampered, F.unhex(leaf_digest(changed))).alias("seen"))
    nodes = placed(leaves, "lang", ["doc_id", "digest"], "manifest-leaves")
    rounds = forward(nodes, "lang", ["id", "seen"], "manifest-blocks")
    tops = rounds[-1].select("lang", F.col("top").alias("digest"), F.lit("").alias("all"))
    over = forward(placed(tops, "all", ["lang"], "manifest-subroots"), "all", ["lang"], "manifest-root")
    root = over[-1].select("all", F.lit(b"").alias("path"), F.col("top").alias("root"))
    roots = backward(over, "all", root, "manifest-paths")

    def subroots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                digests = [bytes(x) for x in row["digests"]]
                own = paths(sweep(digests, min(HEIGHT, levels_of(_below(row, len(digests))))), bytes(row["path"]))
                yield pd.DataFrame({"lang": list(row["langs"]), "path": own, "subroot": digests, "root": bytes(row["root"])})

    kind = dict(docs.dtypes)
    given = roots.mapInPandas(subroots, f"lang {kind['lang']}, path binary, subroot binary, root binary")
    blocks = backward(rounds, "lang", stage(given, "manifest-given"), "manifest-proofs")

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                digests = [bytes(x) for x in row["digests"]]
                own = paths(sweep(digests, min(HEIGHT, levels_of(_below(row, len(digests))))), bytes(row["path"]))
                root = bytes(row["root"])
                folded = [fold(d if s is None else bytes(s), p) for d, s, p in zip(digests, row["seens"], own, strict=True)]
                yield pd.DataFrame({
                    "id": pd.Series(list(row["ids"]), dtype=object), "leaf": [d.hex() for d in digests], "subroot": bytes(row["subroot"]).hex(), "root": root.hex(),
                    "proof_sha256": [proof_digest(p) for p in own], "folded_root": [f.hex() for f in folded], "verified": [f == root for f in folded],
                })

    out = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInPandas(prove, out).withColumn("id", F.col("id").cast(kind["doc_id"])).withColumnRenamed("id", "doc_id")
