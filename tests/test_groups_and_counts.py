"""Standards are resolved on groups, and the index counts terms and keeps keys without folding arrays."""

import random
from collections import Counter
from datetime import date

from pyspark.sql import functions as F
from test_rules import CONTEXT, LIBRARY, ref

from contractlake.operators import search_index, standards


def test_resolution_and_search_equal_loops(spark):
    rng = random.Random(11)
    pick = lambda n: rng.choice([None, *range(n)])
    asked = [(i, pick(2), pick(2), pick(2), pick(2), rng.choice([None, "nda"]), "termination") for i in range(25)]
    refs = [ref(i // 2 if i > 70 else i, pick(2), pick(2), pick(2), pick(2), rng.choice([None, "nda"]), text=rng.choice("ab"), kind=rng.choice([None, "k", "approved_clause"]), end=rng.choice([None, None, date(2020, 1, 1)]), version=rng.randint(1, 3)) for i in range(70)]
    refs.append(refs[0])  # a row twice
    c, r, as_of = spark.createDataFrame(asked, CONTEXT), spark.createDataFrame(refs, LIBRARY), F.lit(date(2024, 1, 1))
    out = standards.resolve(c, r, as_of)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    # By the plain way: own level of every candidate, then ranks and texts per context, level, kind.
    rows = standards.candidates(c, r).withColumn("active", standards.is_active(as_of)).withColumn("own", F.when(F.col("active"), standards.match_level())).collect()
    want = []
    for i in {x["context_id"] for x in rows}:
        mine = [x for x in rows if x["context_id"] == i]
        level = min((x["own"] for x in mine if x["own"] is not None), default=None)
        for kind in {x["source_kind"] for x in mine}:
            best = sorted((x for x in mine if x["source_kind"] == kind and x["own"] is not None and x["own"] == level), key=lambda x: (-x["version"], x["knowledge_reference_id"]))
            several = len({x["reference_text"] for x in best}) > 1
            want += [(i, x["knowledge_reference_id"], "selected" if n == 0 else "conflict" if several else "same_text", level) for n, x in enumerate(best)]
            rest = [x for x in mine if x["source_kind"] == kind and (x["own"] is None or x["own"] != level)]
            want += [(i, x["knowledge_reference_id"], "fallback" if x["active"] else "inactive", level) for x in rest]
    got = [tuple(x) for x in out.select("context_id", "knowledge_reference_id", "status", "level").collect()]
    assert Counter(got) == Counter(want)
    hits = standards.search(c.withColumnRenamed("context_id", "query_id"), r, limit=3).select("query_id", "rank", "knowledge_reference_id").collect()
    found = []
    for q in asked:
        fits = [x for x in refs if x[2] is None or x[2] == q[2]]
        fits.sort(key=lambda x: (not (x[3] is not None and x[3] == q[3]), not (x[4] is not None and x[4] == q[4]), -x[14], x[0]))
        found += [(q[0], n, x[0]) for n, x in enumerate(fits[:3], start=1)]
    assert sorted(map(tuple, hits)) == sorted(found)


def test_index_counts_terms_once_and_keeps_keys(spark, tmp_path):
    texts = ["B a K b", None, "", "Éa-1_a " * 400, "x"]
    chunks = spark.createDataFrame([(i * 10**9 - 10, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    index = search_index.build(chunks, str(tmp_path / "i"))
    docs = {x["chunk_id"]: (x["dl"], [tuple(t) for t in x["terms"]]) for x in index.docs.collect()}
    assert docs == {-10: (4, [("a", 1), ("b", 2), ("k", 1)]), 10**9 - 10: (0, []), 2 * 10**9 - 10: (0, []), 3 * 10**9 - 10: (1200, [("1", 400), ("a", 800)]), 4 * 10**9 - 10: (1, [("x", 1)])}
    rows = search_index.postings(index)
    assert "aggregate(keys" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(x["term"], x["chunk_id"], x["tf"], x["dl"]) for x in rows.collect()}
    assert got == {(t, i, n, dl) for i, (dl, terms) in docs.items() for t, n in terms}
