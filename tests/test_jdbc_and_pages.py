"""A database table by ranges, and page lists scored against arrays. The embedded database serves one process, so this is a test and no registered query."""

from pyspark.sql import functions as F

from contractlake.operators import evaluation
from contractlake.plans.bindings import view
from contractlake.sources import io

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_database_table_by_ranges(spark, sf_dir, tmp_path, capsys):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = view(spark, sf_dir, "v_clause").select(
        "clause_id", F.when(F.col("contract_id") % 97 != 0, F.col("contract_id")).cast("long").alias("contract_id"), "page_start", "clause_type", F.col("confidence").cast("double").alias("confidence")
    )
    for _ in range(2):  # the second run changes nothing
        io.write_jdbc(rows, url, "clause", driver=DRIVER)
    back = io.read_jdbc(spark, url, "clause", column="CONTRACT_ID", parts=4, driver=DRIVER)
    assert back.rdd.getNumPartitions() == 4
    assert min(back.groupBy(F.spark_partition_id()).count().toPandas()["count"]) > 0
    plain = lambda df: sorted(map(repr, map(tuple, df.select("clause_id", "contract_id", "page_start", "clause_type", "confidence").collect())))
    assert plain(back) == plain(rows)
    asked = back.filter("page_start = 3").select("contract_id")
    asked.explain("formatted")
    shown = capsys.readouterr().out
    assert "EqualTo(page_start,3)" in shown.replace("PAGE_START", "page_start") and "clause_type" not in shown.lower().split("readschema")[1].split("\n")[0]
    assert asked.count() == rows.filter("page_start = 3").count()


def test_database_table_without_rows_or_range(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    none = spark.createDataFrame([], "id long, v double")
    io.write_jdbc(none, url, "t", driver=DRIVER)
    assert io.read_jdbc(spark, url, "t", column="id", parts=4, driver=DRIVER).count() == 0
    io.write_jdbc(spark.createDataFrame([(7, 1.5), (7, None), (None, 2.5)], "id long, v double"), url, "t", driver=DRIVER)
    assert sorted(map(repr, map(tuple, io.read_jdbc(spark, url, "t", column="id", parts=4, driver=DRIVER).collect()))) == ["(7, 1.5)", "(7, None)", "(None, 2.5)"]


def test_page_lists_equal_arrays(spark):
    page = lambda rows: spark.createDataFrame(rows, "document int, page_number int")
    pages = [(d, p) for d in range(6) for p in range(1, 5)]
    expected = [(0, 1), (0, 2), (1, 1), (2, 3), (2, 3), (3, 1), (3, 2), (9, 1)]
    detected = [(0, 1), (0, 2), (0, 4), (2, 3), (3, 2), (4, 1)]
    recovered = [(0, 2), (2, 3), (2, 3), (5, 1)]
    got = evaluation.low_text_rates(page(pages), page(expected), page(detected), page(recovered))
    lists = [(d, *[sorted({p for x, p in some if x == d}) for some in (expected, detected, recovered)]) for d in range(6)]
    arrays = spark.createDataFrame(lists, "document int, expected_low array<int>, detected_low array<int>, recovered array<int>")
    want = evaluation.low_text_scores(arrays).select("document", "detection_recall", "recovery_rate", "passed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
