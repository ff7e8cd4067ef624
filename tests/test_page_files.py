"""Page rows from raw text files, read by byte ranges."""

import pytest

from contractlake.sources import io

FILES = {
    "long": [f"page {i} " + "x" * (i * 37 % 400) for i in range(1, 301)],
    "two words+plus é.v1": ["one\nline two", "", "  three  ", "vier é"],
    "single": ["only page"],
}


@pytest.fixture
def folder(tmp_path):
    for name, pages in FILES.items():
        end = "" if name == "single" else "\f"
        (tmp_path / f"{name}.txt").write_bytes(("\f".join(pages) + end).encode())
    (tmp_path / "empty.txt").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("size", ["1k", "128m"])
def test_pages_by_byte_ranges(spark, folder, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = io.read_page_files(spark, folder)
        rows = sorted((r["document"], r["page_number"], r["text"], r["source"], r["char_count"]) for r in got.collect())
        ranges = spark.read.option("lineSep", "\f").text(folder).select("_metadata.file_name", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((name, i, text, "text", len(text.strip())) for name, pages in FILES.items() for i, text in enumerate(pages, 1))
    assert rows == want
    assert ranges > 40 or size != "1k"


def test_no_pages(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert io.read_page_files(spark, str(tmp_path)).count() == 0
