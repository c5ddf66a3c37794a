"""Joins of facts, chunks, characters and citations. Each side is summed up before it is joined, so nothing multiplies."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import evidence_tokens
from storyloom.operators.search import sized
from storyloom.sources.tables import kept


def link_evidence(facts: DataFrame, chunks: DataFrame, keys: list[str], tokens: str = "evidence") -> DataFrame:
    """(fact_id, chunk_id): each token's chunk of the same keys, once."""
    named = facts.select(*keys, "fact_id", F.explode(evidence_tokens(F.col(tokens))).alias("idx"))
    return named.join(chunks.select(*keys, "idx", "chunk_id"), [*keys, "idx"]).select("fact_id", "chunk_id").distinct()


def fact_context(facts: DataFrame, established: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts with the chapter that establishes them: their own, else the first event's, else the first chunk's."""
    first = established.groupBy("node_id").agg(F.min("chapter").alias("event_chapter"))
    cited = evidence.groupBy("node_id").agg(F.min("chapter").alias("chunk_chapter"), F.count("*").alias("n_evidence"))
    return facts.join(first, "node_id", "left").join(cited, "node_id", "left").withColumn("est_chapter", F.coalesce("chapter", "event_chapter", "chunk_chapter")).withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def names_of(links: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Distinct names for each key, sorted, without nulls."""
    return links.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(out))


def roster(characters: DataFrame, states: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """One row for each (name, aliases): states before the chapter, with their targets; unknown chapters stay.

    A character all of whose states lie ahead has no row; one without states has.
    """
    joined = characters.join(states, "char_id", "left").join(targets, "state_id", "left")
    kept = joined.where(F.col("chapter").isNull() | (F.col("chapter") < limit))
    pair = F.when(F.col("state").isNotNull(), F.concat_ws(">", "state", "target"))
    return kept.groupBy("name", "aliases").agg(F.array_sort(F.collect_set(pair)).alias("states"))


def entity_match(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, node_id) where the asked name is a node's name or one of its aliases; an equi-join on both.

    With many nodes of one name the pairs are far more than both tables, so they are never exchanged: each side is made
    unique, and a request that asks by several names meets a node by the least of those that this one has.
    """
    known = entities.select("node_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array()))).alias("asked")).where("asked IS NOT NULL")
    known = known.groupBy("node_id").agg(F.collect_set("asked").alias("known")).withColumn("asked", F.explode("known"))
    wanted = requests.where("asked IS NOT NULL").groupBy("query_id").agg(F.collect_set("asked").alias("wanted")).withColumn("asked", F.explode("wanted"))
    met = known.join(sized(wanted), "asked")
    return met.where((F.size("wanted") == 1) | (F.array_min(F.array_intersect("wanted", "known")) == F.col("asked"))).select("query_id", "node_id")


def related_by_name(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """own, and of other those whose (key, name) own doesn't have."""
    return own.unionByName(other.join(own.select(key, "name").distinct(), [key, "name"], "left_anti"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges of any type in both directions, once: (node_id, other)."""
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()


def resolve_cited(cited: DataFrame, aliases: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, rank): citations to chunks in the order cited; a fact's alias stands for its chunks.

    cited: (claim_id, cited array); aliases: (alias, chunk_id, chapter, idx). Unknown aliases go; of one place the first counts.
    """
    named = cited.select("claim_id", F.posexplode("cited").alias("pos", "alias")).join(aliases, "alias")
    first = named.groupBy("claim_id", "chapter", "idx").agg(F.min(F.struct("pos", "chunk_id")).alias("f"))
    order = Window.partitionBy("claim_id").orderBy("f.pos", "chapter", "idx")
    return first.select("claim_id", F.col("f.chunk_id").alias("chunk_id"), F.row_number().over(order).cast("long").alias("rank"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def first_places(body: pa.Array, quotes: pa.Array) -> pa.Array:
    """Where each of a text's quotes begins in it, from 0; -1 where it doesn't."""
    return pa.array([[(b or "").find(q) if q else -1 for q in own or ()] for b, own in zip(body.to_pylist(), quotes.to_pylist(), strict=True)], pa.list_(pa.int32()))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 512) -> DataFrame:
    """Pairs of intervals [a_from, a_to) and [b_from, b_to) of one key that share a place. Both sides go to the bins of `width` that they touch; a pair counts in the bin where it begins."""
    bins = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor((F.col(y) - 1) / width)))
    left, right = a.where("a_to > a_from").withColumn("__bin", bins("a_from", "a_to")), b.where("b_to > b_from").withColumn("__bin", bins("b_from", "b_to"))
    both = left.join(right, [key, "__bin"]).where("a_from < b_to AND b_from < a_to")
    return both.where(F.floor(F.greatest("a_from", "b_from") / width) == F.col("__bin")).drop("__bin")


def match_quotes(truth: DataFrame, claims: DataFrame, texts: DataFrame, n: int = 12) -> DataFrame:
    """(truth_id, doc_id, line_no, kind) of truths (truth_id, g) and claims (doc_id, line_no, q, fields) of texts (doc_id, body), all in loose form.

    kind is the first that holds. quote: the claim's quote and the truth, one holds the other; span: their first places in
    the text overlap; field: a truth of five characters or more, held by the text, is in the claim's fields. Each text is
    searched once for all truths and once for its own quotes, so it never goes with a line, and places meet by bins.
    """
    truth = kept(truth.where(F.col("g") != ""), "truths")
    claims = kept(claims.select("doc_id", "line_no", "q", "fields").withColumn("claim", F.monotonically_increasing_id()), "claims")
    quoted = claims.where(F.col("q") != "")
    markers = truth.select(F.col("truth_id").alias("marker_id"), F.col("g").alias("m"))
    placed = kept(holding(texts, markers), "placed").withColumnRenamed("marker_id", "truth_id")
    own = quoted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "q")).alias("own"))
    at = texts.join(own, "doc_id").select("doc_id", F.explode(F.arrays_zip(F.col("own"), first_places(F.col("body"), F.transform("own", lambda x: x["q"])).alias("at"))).alias("z"))
    at = at.select("doc_id", F.col("z.own.line_no").alias("line_no"), F.col("z.at").alias("b_from"), (F.col("z.at") + F.length("z.own.q")).alias("b_to")).where("b_from >= 0")
    spans = placed.join(truth, "truth_id").select("truth_id", "doc_id", F.col("place").alias("a_from"), (F.col("place") + F.length("g")).alias("a_to"))
    met = overlapping(spans, at, "doc_id").select("truth_id", "doc_id", "line_no", F.lit(2).alias("k"))

    def inside(column: str, some: DataFrame) -> DataFrame:
        """(truth_id, doc_id, line_no): claims whose column holds a truth."""
        held = holding(claims.select(F.col("claim").alias("doc_id"), F.col(column).alias("body")), some).select(F.col("doc_id").alias("claim"), F.col("marker_id").alias("truth_id"))
        return held.join(claims.select("claim", "doc_id", "line_no"), "claim").select("truth_id", "doc_id", "line_no")

    met = met.union(inside("q", markers).withColumn("k", F.lit(1)))
    met = met.union(inside("fields", markers.where(F.length("m") >= 5)).join(placed.select("truth_id", "doc_id"), ["truth_id", "doc_id"], "left_semi").withColumn("k", F.lit(3)))
    # A truth that holds a quote: by the quote's first n characters.
    asked = quoted.select("doc_id", "line_no", "q", F.substring("q", 1, n).alias("start"), F.least(F.length("q"), F.lit(n)).alias("size"))
    places = truth.select("truth_id", "g", F.explode(F.sequence(F.lit(1), F.least(F.length("g"), F.lit(n)))).alias("size"))
    places = places.select("truth_id", "g", "size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("g") - F.col("size") + 1), lambda i: F.substring(F.col("g"), i, F.col("size"))))).alias("start"))
    met = met.union(asked.join(places, ["start", "size"]).where(F.col("g").contains(F.col("q"))).select("truth_id", "doc_id", "line_no", F.lit(1).alias("k")))
    kinds = F.element_at(F.array(F.lit("quote"), F.lit("span"), F.lit("field")), F.col("k"))
    return met.groupBy("truth_id", "doc_id", "line_no").agg(F.min("k").alias("k")).select("truth_id", "doc_id", "line_no", kinds.alias("kind"))


def in_scope(rows: DataFrame, tenants: DataFrame, *keys: str) -> DataFrame:
    """The rows of the tenants asked for; a table partitioned by its tenant is read only where these are."""
    return rows.join(tenants.select(*keys).distinct(), list(keys), "left_semi")


def state_as_of(requests: DataFrame, states: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """requests (key, up_to, ...) with the values of the last state (key, chapter, ...) before up_to, null where there is none.

    The last is by chapter, an unknown one lying before all, then by `order`; without up_to all states count. States are
    first brought down to one a chapter, and requests to one for each (key, up_to). A window then carries the last state
    forward through both together, so no request is ever paired with all states of its key, and a key has as many rows as chapters.
    """
    at = F.coalesce(F.col("chapter").cast("double"), F.lit(float("-inf")))
    last = states.where(F.col(key).isNotNull()).groupBy(key, at.alias("__at")).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    until = F.coalesce(F.col("up_to").cast("double"), F.lit(float("inf")))
    asked = requests.withColumn("__at", until)
    points = asked.select(key, "__at").distinct()
    # A request comes before the states of its own chapter; one without a limit is past them all.
    both = last.select(key, "__at", F.lit(1).alias("__kind"), "__v").unionByName(points.select(key, "__at", F.lit(0).alias("__kind")), allowMissingColumns=True)
    # Unknown chapters lie before every request, also one for the first chapter of all.
    carried = both.withColumn("__last", F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy("__at", "__kind")))
    found = carried.where("__kind = 0").select(key, "__at", *[F.col(f"__last.{v}").alias(v) for v in values])
    return asked.join(found, [key, "__at"], "left").drop("__at")


def marker_bearing(chunks: DataFrame, evidence: DataFrame, markers: DataFrame) -> DataFrame:
    """(kind, node_id): chunks (chunk_id, body) that hold one of the markers (marker_id, m), and facts whose evidence (fact_id, chunk_id, pos), joined in its order, does."""
    joined = evidence.join(chunks, "chunk_id").groupBy("fact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "").alias("body"))
    by = lambda rows, i: holding(rows.select(F.col(i).alias("doc_id"), "body"), markers).select("doc_id").distinct()
    return by(chunks, "chunk_id").select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("node_id")).union(by(joined, "fact_id").select(F.lit("fact"), "doc_id"))


def pending(requested: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests that are done, and those that are not."""
    marks = done.select(key).distinct()
    return requested.join(marks, key, "left_semi"), requested.join(marks, key, "left_anti")


def cited_closure(cited: DataFrame, bridge: DataFrame) -> DataFrame:
    """(claim_id, chunk_id): chunks cited, and those of facts cited."""
    direct = cited.where("kind = 'chunk'").select("claim_id", F.col("node_id").alias("chunk_id"))
    return direct.union(cited.where("kind = 'fact'").join(bridge, "node_id").select("claim_id", "chunk_id")).distinct()


def holding(texts: DataFrame, markers: DataFrame, block_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, marker_id, place): which texts (doc_id, body) hold which markers (marker_id, m), whole and exactly, and where first, from 0.

    Markers go to the texts in blocks of bounded size, dealt by hash; a task searches each text once for all markers
    of a block. Null and empty markers are held by nothing.
    """
    markers = markers.where(F.length("m") > 0)
    blocks, found = int((markers.agg(F.sum(F.length("m"))).first()[0] or 0) // block_chars) + 1, None
    for b in range(blocks):
        ids: dict[str, list[int]] = {}
        for r in markers.where(F.pmod(F.xxhash64("m"), F.lit(blocks)) == b).collect():  # one block, of a checked size
            ids.setdefault(r["m"], []).append(r["marker_id"])
        shipped = texts.sparkSession.sparkContext.broadcast(ids)

        def search(batches, shipped=shipped):
            import ahocorasick

            index = ahocorasick.Automaton()
            for m, own in shipped.value.items():
                index.add_word(m, (len(m), own))
            index.make_automaton()
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["body"], strict=True):
                    first: dict[int, int] = {}
                    for end, (size, own) in index.iter(t) if t and len(index) else ():
                        for i in own:
                            first.setdefault(i, end + 1 - size)
                    rows.extend((d, i, at) for i, at in first.items())
                yield pd.DataFrame(rows, columns=["doc_id", "marker_id", "place"])

        part = texts.select("doc_id", "body").mapInPandas(search, "doc_id long, marker_id long, place int")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "marker_id").agg(F.min("place").alias("place"))
