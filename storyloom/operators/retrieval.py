"""Search over facts and entities with what stands around them, and all calls of claims at once, for any tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import rules
from storyloom.operators.graph import ancestors
from storyloom.operators.joins import adjacency, entity_match, fact_context, names_of, related_by_name
from storyloom.operators.search import searched, top_k
from storyloom.sources.tables import kept


def around_facts(ids: DataFrame, facts: DataFrame, established: DataFrame, evidence: DataFrame, people: DataFrame, related: DataFrame) -> DataFrame:
    """The facts of ids (node_id) with their chapter, n_evidence, people and related names, both sorted.

    established (node_id, chapter) of the events that establish a fact; evidence (node_id, chapter, ...) its chunks; people
    and related (node_id, name). All are cut to the asked facts before they are summed up.
    """
    own = lambda rows: rows.join(ids, "node_id", "left_semi")
    out = fact_context(own(facts), own(established), own(evidence))
    return out.join(names_of(own(people), "node_id", "name", "people"), "node_id", "left").join(names_of(own(related), "node_id", "name", "related"), "node_id", "left")


def fact_search(requests: DataFrame, facts: DataFrame, established: DataFrame, evidence: DataFrame, people: DataFrame, related: DataFrame, k: int, wide: int = 10) -> DataFrame:
    """(query_id, rank, score, and all that around_facts gives) of the k best facts of each request by words and vectors.

    requests: (query_id, text, vec[, up_to]); facts: (node_id, text, vec, chapter, ...).
    """
    hits = kept(searched(requests, facts, k, wide).select("query_id", "node_id", "rank", "score"), "hits")
    return hits.join(around_facts(hits.select("node_id").distinct(), facts.drop("vec"), established, evidence, people, related), "node_id")


def entity_search(requests: DataFrame, entities: DataFrame, above: DataFrame, own_side: DataFrame, other_side: DataFrame) -> DataFrame:
    """(query_id, node_id, name, parents, related) of entities asked for by name or alias.

    requests: (query_id, asked); entities: (node_id, name, aliases); above: edges (src, dst) to what a thing is part of, of
    which all ancestors count; own_side, other_side (node_id, name): counterparts of relations, the other side's only
    where the own side doesn't have the name. Lists are sorted.
    """
    met = kept(entity_match(requests, entities).join(entities.select("node_id", "name"), "node_id"), "met")
    ids = met.select("node_id").distinct()
    side = lambda rows: rows.join(ids, "node_id", "left_semi").select("node_id", "name").distinct()
    related = names_of(related_by_name(side(own_side), side(other_side), "node_id"), "node_id", "name", "related")
    up = ancestors(above).withColumnRenamed("node", "node_id").join(ids, "node_id", "left_semi")
    parents = names_of(up, "node_id", "ancestor", "parents")
    return met.join(related, "node_id", "left").join(parents, "node_id", "left").select("query_id", "node_id", "name", "parents", "related")


def entity_facts(met: DataFrame, edges: DataFrame, facts: DataFrame, established: DataFrame, evidence: DataFrame, people: DataFrame, up_to: int | None = None, most: int = 60) -> DataFrame:
    """(query_id, rank, ...): facts that an edge of any kind joins with the entities of met (query_id, node_id), the first `most` by chapter, order and name, up to a chapter."""
    near = met.select("query_id", "node_id").join(adjacency(edges), "node_id").select("query_id", F.col("other").alias("node_id"))
    near = kept(near.join(facts.select("node_id"), "node_id", "left_semi").distinct(), "near")
    none = people.limit(0)
    rows = near.join(around_facts(near.select("node_id").distinct(), facts, established, evidence, people, none).drop("related"), "node_id")
    rows = rows.where(rules.up_to_chapter(F.col("est_chapter"), up_to))
    return top_k(rows, "query_id", [F.asc_nulls_last("est_chapter"), F.asc_nulls_last("story_order"), F.asc("name"), F.asc("node_id")], most)


def claim_retrieve(calls: DataFrame, chunks: DataFrame, facts: DataFrame, k: int, wide: int = 10) -> DataFrame:
    """(claim_id, channel, node_id, rank, has_text): what all calls of all claims find, each text with the first hit of its claim only.

    calls: (claim_id, channel, tool, text, vec, up_to); chunks and facts: (node_id, text, vec, chapter), with ids that differ.
    Calls of hybrid_search go to the chunks, those of fact_search to the facts, both by words and vectors, each cut at its own
    chapter before the best are taken.
    """
    calls = kept(calls.withColumn("query_id", F.xxhash64("claim_id", "channel")), "calls")
    found = None
    for tool, nodes in (("hybrid_search", chunks), ("fact_search", facts)):
        hits = searched(calls.where(F.col("tool") == tool).select("query_id", "text", "vec", "up_to"), nodes, k, wide).select("query_id", "node_id", "rank")
        found = hits if found is None else found.union(hits)
    texts = chunks.select("node_id", "text").union(facts.select("node_id", "text")).select("node_id", F.md5(F.regexp_replace("text", r"\s+", "").cast("binary")).alias("k"))
    h = found.join(calls.select("query_id", "claim_id", "channel"), "query_id").join(texts, "node_id")
    first = F.row_number().over(Window.partitionBy("claim_id", "k").orderBy("channel", "rank")) == 1
    return h.select("claim_id", "channel", "node_id", F.col("rank").cast("long").alias("rank"), first.alias("has_text"))
