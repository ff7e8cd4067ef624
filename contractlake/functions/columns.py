"""Column functions that several operators share; all run in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlake.functions.rules import DURATION, HEADING

#: Ends of lines as text readers know them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    """Blanks of any kind at both ends go."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the text holds one of the phrases; the text should be lower-cased."""
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def section_heading(text: Column) -> Column:
    """The first line that is not blank, if it looks like a heading; else null."""
    first = F.try_element_at(F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != ""), F.lit(1))
    return F.when((F.length(first) <= 80) & first.rlike(HEADING), first)


def clean_text(text: Column) -> Column:
    """Joins words broken at line ends, collapses blanks, turns single line ends into blanks, drops what can't be printed, trims."""
    c = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    c = F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    return strip(c)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text trimmed, lower-cased, blanks collapsed."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " "), 256)


def clause_hash(clause_type: Column, party: Column, text: Column) -> Column:
    """Content hash of type, party and text together."""
    parts = [F.coalesce(x, F.lit("")) for x in (clause_type, party, text)]
    return content_hash(F.concat_ws("|", *parts))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def preview(text: Column, size: int = 240) -> Column:
    """Blanks collapsed, cut at `size` with an ellipsis."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def capped(text: Column, size: int, note: str = "") -> Column:
    """The first `size` characters, with a note where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(note))).otherwise(text)


def collection_key(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\W+", "_")


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def duration_days(text: Column) -> Column:
    """Every duration that the text names, in days: months count 30, years 365."""
    number = F.regexp_extract_all(text, F.lit(DURATION), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(DURATION), F.lit(2))
    factor = lambda u: F.when(F.lower(u).startswith("day"), 1).when(F.lower(u).startswith("month"), 30).otherwise(365)
    return F.zip_with(number, unit, lambda n, u: n.cast("bigint") * factor(u))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    lengths = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def rank_of(value: Column, ranks: dict[str, int], missing: int | None = None) -> Column:
    """The number that a table gives to a value."""
    found = F.lit(missing).cast("int")
    for name, rank in ranks.items():
        found = F.when(value == name, rank).otherwise(found)
    return found


def epoch(iso: Column) -> Column:
    """Seconds of an ISO date at midnight UTC; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
