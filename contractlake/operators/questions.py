"""Questions: style, route, topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules


def query_style(q: Column) -> Column:
    exact = F.lit(False)
    for p in rules.EXACT_PATTERNS:
        exact = exact | q.rlike(p)
    return F.when(exact, "exact_match").when(C.any_of(F.lower(q), rules.SEMANTIC_PHRASES), "semantic").otherwise("balanced")


def alpha(style: Column) -> Column:
    out = F.lit(rules.ALPHA_BY_STYLE["balanced"])
    for name, a in rules.ALPHA_BY_STYLE.items():
        out = F.when(style == name, a).otherwise(out)
    return out


def whole_document(q: Column) -> Column:
    """A request for all of a document: a phrase, or at most five words with a summary among them."""
    low = C.strip(F.lower(q))
    words = F.filter(F.split(F.regexp_replace(low, r"(?U)[^a-z\s]", ""), r"(?U)\s+"), lambda w: w != "")
    short = (F.size(words) <= 5) & F.exists(words, lambda w: w.startswith("summar") | (w == "overview"))
    return C.any_of(low, rules.WHOLE_DOCUMENT_PHRASES) | short


def routes(q: Column, decided: Column | None = None) -> Column:
    """The routes of a question; undecided ones take `decided` (an array from a model), else hybrid."""
    low, style = F.lower(q), query_style(q)
    graph, topic = C.any_of(low, rules.GRAPH_PHRASES), C.any_of(low, rules.TOPIC_PHRASES)
    each = lambda *names: F.array(*map(F.lit, names))
    if decided is not None:
        known = F.filter(decided, lambda r: r.isin("hybrid", "graph", "direct"))
        alone = F.filter(known, lambda r: r != "direct")
        known = F.when(F.array_contains(known, "direct") & (F.size(known) > 1), alone).otherwise(known)
        rest = F.when(F.size(known) > 0, known).otherwise(each("hybrid"))
    else:
        rest = each("hybrid")
    return (
        F.when(whole_document(q), each("whole_document")).when(graph & topic, each("hybrid", "graph")).when(graph, each("graph"))
        .when(style != "balanced", each("hybrid")).otherwise(F.coalesce(rest, each("hybrid")))
    )


def topic(q: Column) -> Column:
    """The first clause type, in their order, that a question names; else null."""
    low = F.lower(q)
    return F.coalesce(*[F.when(C.any_of(low, words), F.lit(name)) for name, words in rules.TOPICS])


def template_vendor(q: Column) -> Column:
    """The vendor of a question about the same clause under several judgments; null if it is no such question."""
    low = F.lower(q)
    asks = low.contains("vendor") & low.contains("same clause") & (low.contains("judgment") | low.contains("judgement"))
    vendor = C.strip(F.regexp_extract(q, rules.VENDOR, 1))
    return F.when(asks & (vendor != ""), vendor)


def mutates(statement: Column) -> Column:
    """Whether a query statement would change the graph."""
    return statement.rlike(rules.MUTATING)


def classify(questions: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Adds style, alpha, routes, route, topic to questions (question_id, question). decisions: question_id, decided."""
    rows = questions if decisions is None else questions.join(decisions, "question_id", "left")
    q, decided = F.col("question"), None if decisions is None else F.col("decided")
    out = rows.withColumns({"style": query_style(q), "routes": routes(q, decided), "topic": topic(q)})
    return out.withColumns({"alpha": alpha(F.col("style")), "route": F.col("routes")[0]})
