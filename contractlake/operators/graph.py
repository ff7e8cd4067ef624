"""The clause graph: nodes and edges are tables, traversals are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.operators import dedup, retrieval
from contractlake.session import shared_path

#: Most clauses that are compared pair by pair.
ALL_PAIRS = 20_000


def same_clause_edges(clauses: DataFrame, *, k: int = 3, least: float = 0.90, blocked: bool = True) -> DataFrame:
    """src, dst, similarity: each clause's k nearest clauses of other contracts, at or above `least`. clauses: clause_id, contract_id, embedding.

    Only cells of vectors that may hold one at `least` meet; `blocked=False` compares all pairs as rows, for ids that are no numbers,
    and refuses more than `ALL_PAIRS` clauses.
    """
    if blocked:
        queries = clauses.select(F.col("clause_id").alias("query_id"), "contract_id", F.col("embedding").alias("query_vector"))
        found = retrieval.blocked_top_k(queries, clauses, k, key="clause_id", least=least, exclude="contract_id")
        return found.select(F.col("query_id").alias("src"), F.col("clause_id").alias("dst"), F.col("score").alias("similarity"))
    from contractlake.functions import columns as C

    if clauses.limit(ALL_PAIRS + 1).count() > ALL_PAIRS:
        raise ValueError(f"more than {ALL_PAIRS} clauses: use blocked=True")
    side = clauses.withColumn("n", C.norm(F.col("embedding")))
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.clause_id") != F.col("b.clause_id")) & (F.col("a.contract_id") != F.col("b.contract_id")))
    score = C.cosine(F.col("a.embedding"), F.col("b.embedding"), F.col("a.n"), F.col("b.n"))
    scored = pairs.select(F.col("a.clause_id").alias("src"), F.col("b.clause_id").alias("dst"), score.alias("similarity")).filter(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def conflict_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, reason from clause pairs (clause_a, clause_b, delta_days), one edge a pair."""
    reason = F.concat(F.lit("terms differ by "), F.col("delta_days").cast("string"), F.lit(" days"))
    return pairs.select(F.col("clause_a").alias("src"), F.col("clause_b").alias("dst"), reason.alias("reason")).groupBy("src", "dst").agg(F.min("reason").alias("reason"))


def conflict_flags(edges: DataFrame) -> DataFrame:
    """A high-severity flag on the first clause of each conflicting pair."""
    return edges.select(
        F.col("src").alias("clause_id"), F.lit("conflicting_terms").alias("category"), F.lit("high").alias("severity"),
        F.lit(0.85).alias("confidence"), "reason",
    )


def judgment_graph(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgment nodes, clause-interpreted-by edges) from inline citations: clause_id, judgment_citations (array of struct<citation, court>), seq."""
    each = clauses.select("clause_id", "seq", F.explode("judgment_citations").alias("j")).select("clause_id", "seq", "j.citation", "j.court").filter(F.trim("citation") != "")
    nodes = dedup.merge_nodes(each.select("citation", "court", "seq"), "citation", "seq")
    return nodes, each.select("clause_id", "citation").distinct()


def shared_interpretations(vendors: DataFrame, contains: DataFrame, same: DataFrame, interpreted: DataFrame, *, least: int = 2, limit: int | None = 25) -> DataFrame:
    """Vendor's contract -> clause -> same clause elsewhere, where the clause is interpreted by at least `least` judgments.

    vendors: contract_id, vendor. contains: contract_id, clause_id. same: src, dst. interpreted: clause_id, citation.
    """
    cited = interpreted.groupBy("clause_id").agg(F.array_sort(F.collect_set("citation")).alias("citations")).filter(F.size("citations") >= least)
    links = same.select("src", "dst").union(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    start = vendors.join(contains, "contract_id").join(cited, "clause_id")
    other = contains.select(F.col("clause_id").alias("dst"), F.col("contract_id").alias("other_contract"))
    rows = start.join(links, F.col("clause_id") == F.col("src")).join(other, "dst").filter(F.col("contract_id") != F.col("other_contract"))
    rows = rows.select("vendor", "contract_id", "other_contract", "clause_id", "citations").distinct()
    return rows if limit is None else rows.orderBy("vendor", "contract_id", "other_contract", "clause_id").limit(limit)


def clauses_of(contracts: DataFrame, clauses: DataFrame) -> DataFrame:
    """All typed clauses of the given contracts."""
    return clauses.filter(F.col("clause_type").isNotNull()).join(contracts.select("contract_id"), "contract_id", "left_semi")


def citation_edges(answers: DataFrame, clauses: DataFrame) -> DataFrame:
    """question_id, clause_id: distinct clauses that approved answers of the graph route cite. answers: question_id, route, status, cited (array)."""
    good = answers.filter((F.col("status") == "approved") & (F.col("route") == "graph"))
    each = good.select("question_id", F.explode(F.array_distinct("cited")).alias("clause_id")).distinct()
    return each.join(clauses.select("clause_id").distinct(), "clause_id", "left_semi")


def hop(rows: DataFrame, edges: DataFrame, start: str, to: str, *, direction: str = "out") -> DataFrame:
    """Follows edges (src, dst) from column `start` of `rows` into a new column `to`; direction: out, in or both."""
    out = edges.select(F.col("src").alias("__from"), F.col("dst").alias(to))
    back = edges.select(F.col("dst").alias("__from"), F.col("src").alias(to))
    links = {"out": out, "in": back, "both": out.union(back)}[direction]
    return rows.join(links, F.col(start) == F.col("__from")).drop("__from")


def contract_edges(documents: DataFrame, parties: DataFrame) -> DataFrame:
    """src, edge_type, dst, role: PRODUCED and HAS_VENDOR from documents (document_id, job_id, contract_id, vendor), HAS_PARTY from parties (contract_id, name, role, seq), the role of the last write."""
    none = F.lit(None).cast("string")
    edge = lambda df, a, kind, b, role=none: df.select(F.col(a).cast("string").alias("src"), F.lit(kind).alias("edge_type"), F.col(b).cast("string").alias("dst"), role.alias("role"))
    made = edge(documents.filter("job_id is not null"), "job_id", "PRODUCED", "contract_id")
    sold = edge(documents.filter("vendor is not null"), "contract_id", "HAS_VENDOR", "vendor")
    held = parties.groupBy("contract_id", "name").agg(F.max_by("role", "seq").alias("role"))
    return made.unionByName(sold).distinct().unionByName(edge(held, "contract_id", "HAS_PARTY", "name", F.col("role")))


def shared_ends(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) into nodes that several sources share; no other node lies between two sources.

    Ends meet by a hash in aggregates of two bounds, so an end of many sources stays small. Ends that share a hash may stay too.
    """
    edges = edges.select("src", "dst", F.xxhash64("dst").alias("end")).dropna()
    shared = edges.groupBy("end").agg(F.min("src").alias("low"), F.max("src").alias("high")).filter("low < high").select("end")
    return edges.join(shared, "end", "left_semi").select("src", "dst")


def reachable(starts: DataFrame, edges: DataFrame, *, most: int | None = None, direction: str = "out") -> DataFrame:
    """origin, node, hops: each node that paths of any length (or of `most` hops) reach from the starts of an origin, by the fewest hops.

    starts: origin, node. edges: src, dst. Only pairs found in the last round are followed, and pairs found before are dropped by an anti
    join, so cycles end. Each round is a table in the folder that the cluster shares; the driver holds its row count. Starts are at 0 hops,
    without edges too; null nodes are no nodes.
    """
    spark = starts.sparkSession
    root = shared_path(spark, "reach")
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = {"out": out, "in": back, "both": out.union(back)}[direction].dropna().distinct()
    links.write.parquet(f"{root}/links")
    links = spark.read.parquet(f"{root}/links")
    starts.select("origin", "node").filter("node IS NOT NULL").distinct().write.parquet(f"{root}/seen/hops=0")
    hops, seen = 0, spark.read.parquet(f"{root}/seen")
    schema = seen.schema
    new = seen
    while (most is None or hops < most) and not new.isEmpty():
        hops += 1
        front = new.select("origin", F.col("node").alias("src"))
        found = front.join(links, "src").select("origin", F.col("dst").alias("node")).distinct()
        known = seen.select(F.col("origin").alias("o"), F.col("node").alias("n"))
        fresh = found.join(known, F.col("origin").eqNullSafe(F.col("o")) & (F.col("node") == F.col("n")), "left_anti")
        fresh.write.parquet(f"{root}/seen/hops={hops}")
        new = spark.read.schema(schema).parquet(f"{root}/seen").filter(F.col("hops") == hops)
        seen = spark.read.schema(schema).parquet(f"{root}/seen")
    return seen.select("origin", "node", "hops")
