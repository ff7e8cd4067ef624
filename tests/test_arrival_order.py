"""Batches of clause arrivals follow the order of arrival, where part keys outgrow the places that the order leaves them."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from contractlake.plans import queries


@pytest.mark.parametrize("name", ["d2_clause_upsert", "x2_merged_clauses"])
def test_wide_keys(spark, sf_dir, tmp_path, name):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey < 200")
    one = lines.limit(1)
    put = lambda page, part, supplier, confidence: one.select([
        {"l_orderkey": F.lit(7), "l_linenumber": F.lit(page), "l_partkey": F.lit(part), "l_suppkey": F.lit(supplier), "l_discount": F.lit(confidence), "l_returnflag": F.lit("R")}
        .get(c, F.col(c)).cast(t).alias(c) for c, t in lines.dtypes
    ])
    # The third page's part comes after the fifth's; two parts of other suppliers share a place.
    odd = put(3, 800_000, 1, 0.5).unionByName(put(5, 8, 1, 0.25)).unionByName(put(1, 16, 80_000, 0.125)).unionByName(put(1, 24, 0, 0.0625))
    lines.filter("l_orderkey <> 7").unionByName(odd).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
