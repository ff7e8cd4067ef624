"""Pages to clean text and chunks.

A page row is (document, page_number, text, source); windows partition by document, so the work of
one document is one task's and documents spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import columns as C

LOW_TEXT, CHUNK, OVERLAP = 20, 1000, 150


def low_text_pages(pages: DataFrame, least: int = LOW_TEXT) -> DataFrame:
    """Pages whose text, trimmed, is shorter than `least`."""
    return pages.filter(F.length(C.strip(F.col("text"))) < least)


def overlay_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Recognised text (document, page_number, ocr_text) takes the place of a page's own where there is some."""
    joined = pages.join(ocr.select("document", "page_number", "ocr_text"), ["document", "page_number"], "left")
    has = F.col("ocr_text").isNotNull()
    text = F.coalesce("ocr_text", "text")
    return joined.select(
        "document", "page_number", text.alias("text"), F.when(has, "ocr").otherwise(F.col("source")).alias("source"),
        F.length(C.strip(text)).alias("char_count"),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """Adds `section`: the last heading at or before each page."""
    before = W.partitionBy("document").orderBy("page_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("section", F.last(C.section_heading(F.col("text")), ignorenulls=True).over(before))


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", C.clean_text(F.col("text")))


def page_offsets(cleaned: DataFrame) -> DataFrame:
    """Adds `start_offset`: where each cleaned page begins in its document, pages joined by one blank."""
    before = W.partitionBy("document").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    return cleaned.withColumn("start_offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def document_texts(cleaned: DataFrame) -> DataFrame:
    """document, full_text (each page followed by a blank), pages (array of struct<start_offset, page_number, source, section>)."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text", "start_offset", "source", "section")))
    grouped = page_offsets(cleaned).groupBy("document").agg(parts.alias("p"))
    return grouped.select(
        "document",
        F.concat(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit(" ")).alias("full_text"),
        F.transform("p", lambda x: F.struct(x["start_offset"].alias("start_offset"), x["page_number"].alias("page_number"), x["source"].alias("source"), x["section"].alias("section"))).alias("pages"),
    )


def window_starts(length: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Where the windows of a text of `length` characters begin: one follows as long as more than the overlap is left."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(length - overlap - 1, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long"))


def page_lookup(positions: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_number, section and source of the page that each position (document, offset) stands on: the last page that begins at or before it.

    Positions and page starts (document, start_offset, page_number, section, source) are swept together in one sort: linear in both.
    """
    page = F.struct("page_number", "section", "source")
    starts = pages.select("document", F.col("start_offset").cast("long").alias("_at"), F.lit(0).alias("_kind"), page.alias("_page"), F.lit(None).cast(_row_type(positions)).alias("_row"))
    asked = positions.select("document", F.col("offset").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_page"].dataType).alias("_page"), F.struct(*positions.columns).alias("_row"))
    sweep = W.partitionBy("document").orderBy("_at", "_kind", "_page.page_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = starts.unionByName(asked).withColumn("_page", F.last("_page", ignorenulls=True).over(sweep)).filter("_kind = 1")
    return swept.select("_row.*", "_page.page_number", "_page.section", "_page.source")


def _row_type(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType


def page_windows(pages: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """document, window, offset, piece and the page's columns: what each cleaned page (start_offset, text) gives to the windows that touch it.

    Texts lie on a grid of cells, `size - overlap` characters wide. A page is cut at the grid once, whatever its length; a cell belongs to the window that begins with
    it, and its head, the halo, to those before that reach into it.
    """
    step, text = size - overlap, F.concat("text", F.lit(" "))
    cell = F.floor(F.col("start_offset") / step)
    head = (F.lit(step) - F.pmod("start_offset", F.lit(step))).cast("int")
    cuts = F.concat(F.array(F.substring(text, F.lit(1), head)), F.regexp_extract_all(F.substring(text, head + 1, F.length(text)), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    kept = [c for c in ("document", "page_number", "section", "source") if c in pages.columns]
    cells = pages.select(*kept, F.col("start_offset").cast("long").alias("start_offset"), cell.alias("first"), F.posexplode(cuts).alias("i", "cut"))
    cells = cells.select(*kept, (F.col("first") + F.col("i")).alias("cell"), F.when(F.col("i") == 0, F.col("start_offset")).otherwise((F.col("first") + F.col("i")) * step).alias("offset"), "cut")
    reach = -(-size // step)
    part = lambda k: F.struct(
        (F.col("cell") - k).alias("window"),
        F.substring("cut", F.lit(1), F.greatest(F.lit(size) - F.col("offset") + (F.col("cell") - k) * step, F.lit(0)).cast("int")).alias("piece"),
    )
    given = F.filter(F.array(*map(part, range(reach))), lambda x: (x["window"] >= 0) & (x["piece"] != ""))
    return cells.select(*kept, "offset", F.explode(given).alias("g")).select(*kept, "offset", "g.window", "g.piece")


def chunk_pages(pages: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of documents, with the pages and section that each stands on; blank windows take no index.

    No document becomes one row: each page gives its characters to the windows that touch it, and a window is put together from at most `size` pieces, the
    first and last of which name its pages. Pages are dealt by document once; all steps after that leave them where they lie.
    """
    parts = page_windows(page_offsets(clean_pages(page_sections(pages))), size, overlap)
    pieces = F.array_sort(F.collect_list(F.struct("offset", "piece", "page_number", "section", "source")))
    filled = parts.groupBy("document", "window").agg(pieces.alias("p"), F.sum(F.length("piece")).alias("n")).filter((F.col("window") == 0) | (F.col("n") > overlap))
    rows = filled.select(
        "document", "window", C.strip(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("text"), F.get("p", F.lit(0)).alias("a"), F.element_at("p", -1).alias("b"),
    ).filter("text <> ''")
    rows = rows.withColumn("chunk_index", F.row_number().over(W.partitionBy("document").orderBy("window")) - 1)
    return rows.select(
        F.concat_ws(":", F.col("document").cast("string"), F.col("chunk_index").cast("string"), F.substring(C.content_hash(F.col("text")), 1, 16)).alias("chunk_id"),
        "document", "chunk_index", "text", F.col("a.page_number").alias("page_start"), F.col("b.page_number").alias("page_end"), F.col("a.section").alias("section"),
        F.array_sort(F.array_distinct(F.array("a.source", "b.source"))).alias("sources"),
    )


def table_markdown(cells):
    """A table (array of rows of cells) as markdown, its first row the head; null cells are empty."""
    cell = lambda c: F.translate(F.coalesce(c, F.lit("")), "\n|", " /")
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, cell), " | "), F.lit(" |"))
    rule = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(line(cells[0]), rule(cells[0])), body), "\n")).otherwise("")


def table_chunks(tables: DataFrame, text_counts: DataFrame) -> DataFrame:
    """Chunks of tables (document, page_number, table_index, rows); their indexes go on after the document's text chunks.

    text_counts: document, n_chunks. Tables without a cell are left out.
    """
    flat = F.flatten("rows")
    full = tables.filter(F.exists(flat, lambda c: F.coalesce(c, F.lit("")) != ""))
    full = full.join(text_counts, "document", "left")
    turn = F.row_number().over(W.partitionBy("document").orderBy("page_number", "table_index")) - 1
    return full.select(
        F.concat_ws(":", F.col("document").cast("string"), F.lit("table"), F.col("page_number").cast("string"), F.col("table_index").cast("string")).alias("chunk_id"),
        "document", (F.coalesce("n_chunks", F.lit(0)) + turn).alias("chunk_index"), table_markdown(F.col("rows")).alias("text"),
        F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_columns"), "page_number",
    )


def whole_documents(chunks: DataFrame) -> DataFrame:
    """document, text: chunks in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("document").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def ocr_ratio(pages: DataFrame, least: int = LOW_TEXT) -> DataFrame:
    """document, ocr_ratio: share of pages with little text."""
    short = F.when(F.length(C.strip(F.col("text"))) < least, 1.0).otherwise(0.0)
    return pages.groupBy("document").agg(F.avg(short).alias("ocr_ratio"))
