"""Rules on chapters, labels, verdicts, claims and routes, each in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that are not of the story, and price in USD of a million tokens (fresh, cached, written).
META_LABELS = ["__Entity__", "__KGBuilder__", "Chunk", "Chapter", "Story", "Fact"]
PRICE_IN, PRICE_CACHED, PRICE_OUT = 0.20, 0.02, 1.20
#: A finding needs at least this score.
TAU = 7


def tenant_id(user: Column, work: Column) -> Column:
    return F.concat_ws(":", user.cast("long").cast("string"), work.cast("long").cast("string"))


def tenant_ft(user: Column, work: Column) -> Column:
    return F.concat(F.lit("u"), user.cast("long").cast("string"), F.lit("w"), work.cast("long").cast("string"))


def before_chapter(chapter: Column, limit: int | Column) -> Column:
    """Strictly before; unknown chapters stay."""
    return chapter.isNull() | (chapter < limit)


def up_to_chapter(chapter: Column, limit: int | None) -> Column:
    """Up to and including; unknown chapters go unless there is no limit."""
    return F.lit(True) if limit is None else F.coalesce(chapter <= limit, F.lit(False))


def not_future(chapter: Column, limit: int | None) -> Column:
    """Text that is no integer is an unknown chapter, which stays."""
    known = chapter.try_cast("int")
    return F.lit(True) if limit is None else known.isNull() | (known < limit)


def domain_label(labels: Column) -> Column:
    """The first label of the story's own, else 'Node'."""
    own = F.filter(labels, lambda x: ~x.isin(META_LABELS))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("Node"))


def clamp_score(raw: Column) -> tuple[Column, Column]:
    """Score from 0 to 10, and flags; what is no integer counts as 0."""
    score = raw.try_cast("int")
    flags = F.array_compact(F.array(F.when(score.isNull(), F.lit("score_not_int")), F.when((score < 0) | (score > 10), F.lit("score_out_of_range"))))
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(score, F.lit(0)))), flags


def picked_lines(picked: Column, candidates: Column) -> tuple[Column, Column]:
    """The picked lines if they are candidates, else all candidates; and whether it fell back."""
    fell = (F.size(candidates) > 0) & ((F.size(picked) <= 0) | (F.size(F.array_except(picked, candidates)) > 0))
    return F.when(fell, candidates).otherwise(picked), fell


def in_bounds(lines: Column, n: Column) -> Column:
    return F.filter(lines, lambda x: (x >= 1) & (x <= n))


def fact_text(name: Column, description: Column) -> Column:
    """'name: description' without what is missing."""
    return F.concat_ws(": ", F.when(name != "", name), F.when(description != "", description))


def extras(values: Column, hidden: list[str]) -> Column:
    """'k=v, k=v' of a map's entries, in order of k, but for hidden keys, keys that start with __ and empty values."""
    shown = F.map_filter(values, lambda k, v: ~k.isin(hidden) & ~k.startswith("__") & (F.coalesce(v, F.lit("")) != ""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def cost(prompt: Column, cached: Column, completion: Column) -> Column:
    return ((prompt - cached) * PRICE_IN + cached * PRICE_CACHED + completion * PRICE_OUT) / 1e6


def cold_cost(prompt: Column, completion: Column) -> Column:
    return (prompt * PRICE_IN + completion * PRICE_OUT) / 1e6


def _calls(*pairs: tuple[Column, str, Column]) -> Column:
    calls = F.array(*[F.when(cond, F.struct(F.lit(tool).alias("tool"), text.alias("query_text"))) for cond, tool, text in pairs])
    return F.filter(calls, lambda x: x.isNotNull())


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def route_qav(axis: Column, value: Column, quote: Column, with_quote: bool = False) -> Column:
    """Calls of a claim: its axis and 'axis: value' on both channels; the quote where there is no axis, or if asked for."""
    axis, value, quote = _clean(axis), _clean(value), _clean(quote)
    has, full = axis != "", F.concat(axis, F.lit(": "), value)
    ask = (quote != "") if with_quote else (quote != "") & ~has
    return _calls((ask, "hybrid_search", quote), (ask, "fact_search", quote), (has, "hybrid_search", axis), (has, "fact_search", axis), (has & (value != ""), "hybrid_search", full), (has & (value != ""), "fact_search", full))


def route_type(kind: Column, subject: Column, attribute: Column, value: Column, quote: Column) -> Column:
    """Calls by the type of a claim (deed, rule, state; anything else is a property)."""
    subject, attribute, value = _clean(subject), _clean(attribute), _clean(value)
    deed, rule, state = (F.coalesce(kind == k, F.lit(False)) for k in ("deed", "rule", "state"))
    other, named = ~(deed | rule | state), subject != ""
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    return _calls(
        (deed, "fact_search", either(attribute, F.coalesce(quote, F.lit("")))),
        (rule, "hybrid_search", F.trim(F.concat_ws(" ", attribute, value))), (rule, "fact_search", either(attribute, value)),
        (state & named, "entity_search", subject), (state, "fact_search", F.trim(F.concat_ws(" ", subject, attribute))),
        (other & named, "entity_search", subject), (other, "hybrid_search", F.trim(F.concat_ws(" ", subject, attribute, value))),
    )


def route_broadcast(anchor: Column, normalized: Column, quote: Column, slim: bool = False) -> Column:
    """All channels for every claim: its anchor's name, its quote, and its normal wording where that differs."""
    from storyloom.functions.text import norm

    anchor, normalized, quote = _clean(anchor), _clean(normalized), _clean(quote)
    more = (normalized != "") & (norm(normalized) != norm(quote))
    return _calls((anchor != "", "entity_search", anchor), (F.lit(True), "hybrid_search", quote), (F.lit(True), "fact_search", quote), (more, "hybrid_search", normalized), (more & F.lit(not slim), "fact_search", normalized))


VERDICTS = "struct<verdicts:array<struct<claimId:string,i:string,score:string,lineIds:array<int>,cited:array<string>,reason:string>>>"
CLAIMS = "struct<claims:array<struct<quote:string,axis:string,value:string,lines:array<int>>>>"
GRAPH = "struct<nodes:array<struct<id:string,label:string,properties:map<string,string>>>,relationships:array<struct<type:string,start_node_id:string,end_node_id:string>>>"


def claim_index(claim_id: Column, i: Column) -> Column:
    """Position from 0: of 'P12' 11, else i - 1; null if neither is a number, or it is beyond an int."""
    by_id = F.regexp_extract(F.coalesce(claim_id, F.lit("")), "^P([0-9]+)$", 1)
    return F.when(by_id != "", by_id.try_cast("int") - 1).otherwise(i.try_cast("int") - 1)
