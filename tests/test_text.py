import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.operators import dedup, normalize, text


def clean(t):
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    t = re.sub(r"(?<!\n)\n(?!\n)", " ", t)
    return "".join(c for c in t if c.isprintable() or c in "\n\t").strip()


def test_clean_text(spark):
    texts = ["inter-\nnational  law\n\n\n\nNext\npage", "a\tb c​d", "\x07bell é-\nà", "", "  x  ", "ein-\n\nzwei"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.clean_text(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: clean(t) for i, t in enumerate(texts)}


def test_headings_are_carried(spark):
    pages = [("d", 1, "\n  1. Scope of Work \nbody", "text"), ("d", 2, "lower case line", "text"), ("d", 3, "Payment (net)\nx", "text"), ("e", 1, "no heading here!", "text")]
    out = text.page_sections(spark.createDataFrame(pages, "document string, page_number int, text string, source string"))
    got = {(r["document"], r["page_number"]): r["section"] for r in out.collect()}
    assert got == {("d", 1): "1. Scope of Work", ("d", 2): "1. Scope of Work", ("d", 3): "Payment (net)", ("e", 1): None}


@pytest.mark.parametrize("length", [1, 999, 1000, 1001, 1850, 1851, 2700, 5999])
def test_chunk_starts(spark, length):
    pages = spark.createDataFrame([("d", 1, "x" * length, "text")], "document string, page_number int, text string, source string")
    got = [len(r["text"]) for r in text.chunk_pages(pages).orderBy("chunk_index").collect()]
    full, want, start = "x" * length + " ", [], 0
    while start < len(full):
        end = min(start + 1000, len(full))
        if full[start:end].strip():
            want.append(len(full[start:end].strip()))
        if end == len(full):
            break
        start = end - 150
    assert got == want


def windows_by_loop(pages, size, overlap):
    """Texts of the windows, their first and last page, by slicing the joined text."""
    full, starts = "", []
    for number, body in pages:
        starts.append((len(full), number))
        full += clean(body) + " "
    page = lambda at: [n for s, n in starts if s <= at][-1]
    out, start = [], 0
    while start < len(full):
        end = min(start + size, len(full))
        if full[start:end].strip():
            out.append((len(out), full[start:end].strip(), page(start), page(max(end - 1, start))))
        if end == len(full):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(1000, 150), (20, 15), (7, 0)])
def test_chunks_by_slicing(spark, size, overlap):
    """Many short pages, empty ones, pages longer than several windows, characters of four bytes."""
    docs = {
        "a": [(i, "p" * (i % 5)) for i in range(1, 40)], "b": [(1, "x" * 3300), (2, ""), (3, "😀é" * 700), (9, "tail")], "c": [(1, "")], "d": [(1, "  "), (2, "word"), (3, " " * 9)],
    }
    rows = [(d, n, t, "text") for d, pages in docs.items() for n, t in pages]
    frame = spark.createDataFrame(rows, "document string, page_number int, text string, source string").repartition(3)
    got = {}
    for r in text.chunk_pages(frame, size, overlap).orderBy("document", "chunk_index").collect():
        got.setdefault(r["document"], []).append((r["chunk_index"], r["text"], r["page_start"], r["page_end"]))
    assert got == {d: w for d, pages in docs.items() if (w := windows_by_loop(pages, size, overlap))}


def test_chunks_are_dealt_once(spark):
    frame = spark.createDataFrame([("d", 1, "x", "text")], "document string, page_number int, text string, source string")
    plan = text.chunk_pages(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "full_text" not in plan


def test_page_lookup_on_positions(spark):
    pages = spark.createDataFrame([("d", 0, 1, None, "text"), ("d", 10, 2, "S", "ocr"), ("e", 0, 1, None, "text")], "document string, start_offset long, page_number int, section string, source string")
    asked = spark.createDataFrame([("d", 0, 7), ("d", 9, 8), ("d", 10, 9), ("d", 999, 10), ("e", 3, 11), ("f", 3, 12)], "document string, offset long, page_number_wanted int")
    got = {r["page_number_wanted"]: (r["page_number"], r["section"], r["source"]) for r in text.page_lookup(asked, pages).collect()}
    assert got == {7: (1, None, "text"), 8: (1, None, "text"), 9: (2, "S", "ocr"), 10: (2, "S", "ocr"), 11: (1, None, "text"), 12: (None, None, None)}


def test_chunks_know_their_pages(spark):
    pages = [("d", 1, "Alpha\n" + "a" * 900, "text"), ("d", 2, "Beta\n" + "b" * 900, "ocr")]
    got = text.chunk_pages(spark.createDataFrame(pages, "document string, page_number int, text string, source string")).orderBy("chunk_index").collect()
    assert [(r["page_start"], r["page_end"], r["section"], r["sources"]) for r in got] == [(1, 2, "Alpha", ["ocr", "text"]), (1, 2, "Alpha", ["ocr", "text"]), (2, 2, "Beta", ["ocr"])][: len(got)]


def test_empty_pages_and_overlay(spark):
    schema = "document string, page_number int, text string, source string"
    assert text.chunk_pages(spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([("d", 1, "short", "text"), ("d", 2, "y" * 30, "text")], schema)
    assert [r["page_number"] for r in text.low_text_pages(pages).collect()] == [1]
    ocr = spark.createDataFrame([("d", 1, " seen ")], "document string, page_number int, ocr_text string")
    got = {r["page_number"]: (r["source"], r["char_count"]) for r in text.overlay_ocr(pages, ocr).collect()}
    assert got == {1: ("ocr", 4), 2: ("text", 30)}


def test_table_markdown_and_indexes(spark):
    rows = [("d", 1, 0, [["a", None], ["x|y", "p\nq"]]), ("d", 2, 0, [[None, ""]])]
    tables = spark.createDataFrame(rows, "document string, page_number int, table_index int, rows array<array<string>>")
    counts = spark.createDataFrame([("d", 3)], "document string, n_chunks int")
    got = text.table_chunks(tables, counts).collect()
    assert [(r["chunk_index"], r["text"], r["n_rows"], r["n_columns"]) for r in got] == [(3, "| a |  |\n| --- | --- |\n| x/y | p q |", 2, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_tokens_match_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.tokens(F.col("t")).alias("t")).collect()
    for r in rows:
        low = texts[r["i"]].lower().replace("İ", "i")
        assert r["t"] == re.findall(r"[a-z0-9]+", low)


def test_counterparty(spark):
    party = lambda n, r: {"name": n, "role": r}
    cases = [
        ([party("A", "customer"), party("B", "the Vendor")], None, "B"), ([party("A", None)], None, "A"), ([party("A", None), party(" ", "vendor"), party("C", "buyer")], None, "A / C"),
        ([], None, None), (None, " Given ", "Given"), ([party("A", "Service Provider")], "", "A"),
    ]
    df = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(cases)], f"i int, p {normalize.PARTIES}, v string")
    got = {r["i"]: r["c"] for r in df.select("i", normalize.counterparty(F.col("p"), F.col("v")).alias("c")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_upsert_is_idempotent_in_rows(spark):
    schema = "document_id int, content_hash string, clause_id string, page_reference int, confidence double, seq int"
    first = spark.createDataFrame([(1, "h", "c1", 1, 0.5, 1), (1, "h", "c2", 2, 0.9, 2), (1, "g", "c3", 1, 0.1, 3)], schema)
    stored = dedup.upsert_clauses(first)
    again = dedup.merge_clauses(stored, first)
    assert again.count() == stored.count() == 2
    row = again.filter("content_hash = 'h'").first()
    assert (row["clause_id"], row["page_reference"], row["confidence"], row["version"]) == ("c1", 2, 0.9, 4)


def test_merge_keeps_values_over_nulls(spark):
    loads = spark.createDataFrame([("n", 1, "a", None), ("n", 2, None, "x"), ("n", 3, "b", None)], "k string, seq int, p string, q string")
    row = dedup.merge_nodes(loads, "k", "seq").first()
    assert (row["p"], row["q"]) == ("b", "x")


def test_bad_responses_are_kept_apart(spark):
    df = spark.createDataFrame([(1, '```json\n{"k": 3}\n```'), (2, "sorry"), (3, None)], "i int, raw string")
    got = {r["i"]: (r["parsed"] and r["parsed"]["k"], r["quarantine"]) for r in normalize.parse_responses(df, "raw", "k int").collect()}
    assert got == {1: (3, None), 2: (None, "sorry"), 3: (None, None)}
