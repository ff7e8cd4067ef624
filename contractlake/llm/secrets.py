"""Secret scans (DataFrame functions only): patterns of known secrets, and windows of high entropy in long strings.

Patterns, as spans of whole matches, leftmost and without overlap per kind: `assign`, a name such as `password` with a
value of at least 8 characters; `access`, an access key id of at least 16; `hex`, at least 32 hex digits. A match's place is
the length of all that stands between and within the matches before it.

Candidate strings are whole runs of at least 24 letters, digits and `+/_=-`, of the class `hexrun` if all are hex digits of either
case, else `base64`, that hold a digit and a letter (`base64`: of both cases). Windows of a fixed width slide over them; a window's Shannon entropy, log2(w) - sum(c log2 c) / w over the
counts c of its characters, is kept up to date by the counts of the character that enters and the one that leaves, in whole numbers
of 2 ** -20 bits, so that no rounding depends on the way. Windows at or above their class's threshold that overlap
make one span. Spans are suppressed where their candidate matches the allow list; the patterns' spans never are.

A row is scanned where it lies: nothing is shuffled, and a candidate is cut into overlapping stretches of `STRETCH`
windows, so the state of a scan is bounded. Null texts count as empty. Repeated rows each have a row. Empty tables give empty
results. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns. Case matters but for the names of `assign`.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGN_LENGTH = 8
#: Order of spans that start at the same place.
KINDS = ("assign", "access", "hex", "hexrun", "base64")
#: Windows handled in one stretch; bits of a whole number that stand for a fraction of a bit.
STRETCH, FRACTION = 2_048, 20
#: A candidate, and what it must hold to be one; candidates on the allow list are no secrets: UUIDs, one character or a pair repeated, alphabets,
#: keyboard rows and digits in order, placeholders.
RUN = r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{24,}+"
HELD = {"hexrun": ("[0-9]", "[A-Fa-f]"), "base64": ("[0-9]", "[a-z]", "[A-Z]")}
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(.{1,2})\1+.?$",
    r"(?i:abcdefghijkl|qwertyuiop|0123456789|1234567890)", r"(?i:example|placeholder|changeme|xxxxxxxx)",
)


class Class(NamedTuple):
    """A character class: its kind of span, its alphabet, width and least entropy (bits) of a window."""

    kind: str
    alphabet: str
    width: int
    least: float


CLASSES = (
    Class("hexrun", "0123456789abcdef", 24, 3.2),
    Class("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
)
SPAN = "struct<start:int,end:int,what:string>"


def weighted(c: int) -> int:
    """c log2 c in whole numbers of 2 ** -FRACTION."""
    return round(c * math.log2(c) * 2**FRACTION) if c else 0


def limit(kind: Class) -> int:
    """The largest sum of c log2 c over a window's counts that its least entropy allows."""
    return math.floor((math.log2(kind.width) - kind.least) * kind.width * 2**FRACTION)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Sums of all entries before each of an array, and of all: one longer than the array."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))


def _stretched(items: Column, size: int) -> Column:
    """An array in slices of at most `size` entries."""
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, what) of a pattern's matches, in code points, end exclusive.

    The gaps between matches and their lengths are summed along the text: within slices of 256 matches, and over slices.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(both: Column) -> Column:
        def slices(k: Column) -> Column:
            part = F.slice(both, k * 256 + 1, 256)
            return let(_running(F.transform(part, lambda x: x["gap"] + F.length(x["what"]))), lambda run: F.struct(
                F.element_at(run, -1).alias("size"), F.transform(part, lambda x, i: F.struct((F.get(run, i) + x["gap"]).alias("start"), F.get(run, i + 1).alias("end"), x["what"].alias("what"))).alias("spans"),
            ))

        def moved(parts: Column) -> Column:
            return let(_running(F.transform(parts, lambda x: x["size"])), lambda before: F.flatten(F.transform(parts, lambda x, k: F.transform(
                x["spans"], lambda y: F.struct((y["start"] + F.get(before, k)).alias("start"), (y["end"] + F.get(before, k)).alias("end"), y["what"].alias("what")),
            ))))

        return let(F.transform(_stretched(both, 256), slices), moved)

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, gap: F.struct(m.alias("what"), gap.alias("gap")))
    return F.when(text.rlike(pattern), let(F.filter(both, lambda x: x["what"].isNotNull()), placed)).otherwise(none)


def windows(chars: Column, first: Column, kind: Class) -> Column:
    """Array of (start, end) of the windows of high entropy that begin within one stretch; overlapping ones are one.

    chars: places in the alphabet (from 0) of the stretch and of the rest of its last window; first: where it begins.
    """
    w, weights = kind.width, F.array(*(F.lit(weighted(c)).cast("long") for c in range(kind.width + 2)))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), spans.alias("spans"),
    )

    def step(s: Column, i: Column) -> Column:
        """One character enters, and one leaves once the window is full."""
        enters, leaves = F.get(chars, i), F.when(i >= w, F.get(chars, i - w)).otherwise(F.lit(-1))
        return let(F.struct(enters.alias("a"), leaves.alias("b")), lambda x: let(F.struct(F.get(s["counts"], x["a"]).alias("a"), F.coalesce(F.get(s["counts"], x["b"]), F.lit(0)).alias("b")), lambda n: moved(s, i, x, n)))

    def moved(s: Column, i: Column, x: Column, n: Column) -> Column:
        same = x["a"] == x["b"]
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k == x["a"], 1).when(k == x["b"], -1).otherwise(0)))
        gain = F.get(weights, n["a"] + 1) - F.get(weights, n["a"]) + F.when(x["b"] >= 0, F.get(weights, n["b"] - 1) - F.get(weights, n["b"])).otherwise(F.lit(0).cast("long"))
        return let(F.struct(counts.alias("counts"), (s["sum"] + F.when(same, F.lit(0).cast("long")).otherwise(gain)).alias("sum"), (first + i - (w - 1)).alias("at")), lambda t: flagged(s, i, t))

    def flagged(s: Column, i: Column, t: Column) -> Column:
        high = (i >= w - 1) & (t["sum"] <= limit(kind))
        apart = high & (t["at"] >= s["end"])
        shut = F.when(apart & (s["start"] >= 0), F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"])
        return F.struct(
            t["counts"].alias("counts"), t["sum"].alias("sum"), F.when(apart, t["at"]).otherwise(s["start"]).alias("start"),
            F.when(high, t["at"] + w).otherwise(s["end"]).alias("end"), shut.alias("spans"),
        )

    ended = lambda s: F.when(s["start"] >= 0, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"])
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, ended)


def _islands(spans: Column) -> Column:
    """Spans in order of their starts and ends, those that overlap made one."""
    starts = F.filter(spans, lambda x, i: (i == 0) | (x["start"] >= F.get(spans, i - 1)["end"]))
    ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] >= x["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def entropy_spans(run: Column, kind: Class) -> Column:
    """Array of (start, end) of windows of high entropy in one candidate (start, end, what)."""
    text = F.lower(run["what"]) if kind.kind == "hexrun" else run["what"]
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(kind.alphabet), c) - 1)

    def stretches(chars: Column) -> Column:
        n = F.floor((F.size(chars) - kind.width) / STRETCH).cast("int")
        part = lambda k: let(F.slice(chars, k * STRETCH + 1, STRETCH + kind.width - 1), lambda x: windows(x, run["start"] + k * STRETCH, kind))
        return let(F.flatten(F.transform(F.sequence(F.lit(0), n), part)), _islands)

    return let(places, stretches)


def _suspect(run: Column, kind: str) -> Column:
    what = run["what"]
    of_kind = what.rlike("^[0-9A-Fa-f]+$") if kind == "hexrun" else ~what.rlike("^[0-9A-Fa-f]+$")
    for pattern in HELD[kind]:
        of_kind = of_kind & what.rlike(pattern)
    for pattern in ALLOWED:
        of_kind = of_kind & ~what.rlike(pattern)
    return of_kind


def _listed(spans: Column, kind: str) -> Column:
    """Spans with their kind and its place in the order of kinds."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["what"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    runs = lambda kind: F.flatten(F.transform(F.filter(F.col("runs"), lambda x: _suspect(x, kind.kind)), lambda x: entropy_spans(x, kind)))
    out = docs.select("doc_id", assigned.alias("assign"), matches(text, ACCESS).alias("access"), matches(text, HEX).alias("hex"), matches(text, RUN).alias("runs"))
    base = F.concat(*(_listed(F.col(k), k) for k in KINDS[:3]))
    more = F.when(F.size("runs") == 0, F.array().cast("array<struct<start:int,kind:int,end:int>>")).otherwise(F.concat(*(_listed(runs(k), k.kind) for k in CLASSES)))
    out = out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), more.alias("more"))
    counts = [f"n_{k}" for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))
