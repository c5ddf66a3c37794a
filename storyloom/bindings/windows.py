"""Windows, top-k and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.bindings.base import EVIDENCE_SQL, FACTS_SQL, evidence, facts
from storyloom.catalog import query, t
from storyloom.operators import aggregates as A
from storyloom.operators import search as S
from storyloom.operators.joins import related_by_name

def W(*keys):
    return Window.partitionBy(*keys)


@query(f"WITH {EVIDENCE_SQL} SELECT node_id, chunk_id, 'C' || lpad(CAST(row_number() OVER (PARTITION BY node_id ORDER BY coalesce(chapter, 0), idx, chunk_id, l_partkey, l_suppkey) AS VARCHAR), 3, '0') AS alias FROM evidence")
def alias_assign(spark, sf):
    e = evidence(spark, sf)
    return e.select("node_id", "chunk_id", A.alias_rank([F.coalesce("chapter", F.lit(0)), "idx", "chunk_id", "l_partkey", "l_suppkey"], ["node_id"], "C", 3).alias("alias"))


@query("SELECT conv_id, turn, 'P' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS claim_id FROM conversations")
def claim_ids(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("P"), F.row_number().over(W("conv_id").orderBy("turn"))).alias("claim_id"))


@query(f"WITH {EVIDENCE_SQL}, u AS (SELECT DISTINCT node_id, chunk_id, idx FROM evidence) SELECT node_id, chunk_id, lead(chunk_id) OVER (PARTITION BY node_id ORDER BY idx) AS next_chunk FROM u")
def next_chunk(spark, sf):
    u = evidence(spark, sf).select("node_id", "chunk_id", "idx").distinct()
    return u.select("node_id", "chunk_id", F.lead("chunk_id").over(W("node_id").orderBy("idx")).alias("next_chunk"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def current_state(spark, sf):
    """The latest state of each character and target; a maximum needs no sort."""
    return t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def state_history(spark, sf):
    w = W("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("previous"), F.row_number().over(w).cast("long").alias("place"))


RECENT_SQL = "recent AS (SELECT source, string_agg('[' || doc_id || '] ' || text, chr(10) ORDER BY doc_id) AS summaries FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents WHERE text <> '') WHERE r <= 3 GROUP BY source)"


def recent_rows(spark, sf):
    d = t(spark, sf, "documents").where("text <> ''").select("source", "doc_id", F.col("text").alias("s"))
    last = S.top_k(d, "source", [F.desc("doc_id")], 3).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("l"))
    return last.select("source", F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["doc_id"].cast("string"), F.lit("] "), x["s"])), "\n").alias("summaries"))


@query(f"WITH {RECENT_SQL} SELECT * FROM recent")
def recent_summaries(spark, sf):
    return recent_rows(spark, sf)


@query("SELECT conv_id, turn, turn = coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS continuous FROM conversations WHERE turn % 4 <> 2")
def continuity_check(spark, sf):
    before = F.lag("turn").over(W("conv_id").orderBy("turn"))
    return t(spark, sf, "conversations").where("turn % 4 <> 2").select("conv_id", "turn", (F.col("turn") == F.coalesce(before + 1, F.lit(0))).alias("continuous"))


@query("SELECT event_id, user_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS skipped_by FROM events")
def cascade_skip(spark, sf):
    w = W("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, sf, "events").select("event_id", "user_id", F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w).alias("skipped_by"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(regexp_replace(text, '\\s+', '', 'g')) ORDER BY doc_id) = 1 AS kept FROM documents")
def channel_dedupe(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", F.md5(F.regexp_replace("text", r"\s+", "").cast("binary")).alias("k"))
    return d.select("doc_id", "source", (F.row_number().over(W("source", "k").orderBy("doc_id")) == 1).alias("kept"))


@query("SELECT o_orderkey, round(year(o_orderdate) - 1991 + (row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1) / 10, 6) AS story_order FROM orders")
def story_order_seq(spark, sf):
    y = F.year("o_orderdate")
    return t(spark, sf, "orders").withColumn("y", y).select("o_orderkey", F.round(F.col("y") - 1991 + (F.row_number().over(W("o_custkey", "y").orderBy("o_orderkey")) - 1) / 10, 6).alias("story_order"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch, turn FROM conversations")
def claim_batches(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", F.floor((F.row_number().over(W("conv_id").orderBy("turn")) - 1) / 4).alias("batch"), "turn")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r <= 3")
def topk_per_query(spark, sf):
    return S.top_k(t(spark, sf, "lineitem"), "l_partkey", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey"], 3).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FACTS_SQL} SELECT char_id, node_id, chapter, story_order FROM (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY chapter NULLS LAST, story_order NULLS LAST, name) AS r FROM facts) WHERE r <= 60")
def entity_facts_top(spark, sf):
    """The first 60 facts of every character."""
    return S.top_k(facts(spark, sf), "char_id", [F.asc_nulls_last("chapter"), F.asc_nulls_last("story_order"), F.asc("name")], 60).select("char_id", "node_id", "chapter", "story_order")


@query("""WITH s AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS node_id, v.label AS vl, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 25 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r2 FROM w WHERE r <= 20 AND ql = vl)
SELECT query_id, node_id, r2 AS rank FROM f WHERE r2 <= 5""")
def oversample_trim(spark, sf):
    """Top 4k, then the tenant, then top k: what filtering after the search loses, as a diagnostic."""
    e = t(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").alias("vec"))
    wide = S.vector_topk(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "vec"), e.select(F.col("vec_id").alias("node_id"), "vec"), 20)
    ql, nl = e.select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("node_id"), "label")
    same = wide.join(ql, "query_id").join(nl, ["node_id", "label"]).drop("rank")
    return S.top_k(same, "query_id", [F.desc(F.round("score", 9)), "node_id"], 5).select("query_id", "node_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FACTS_SQL} SELECT node_id, row_number() OVER (PARTITION BY char_id ORDER BY coalesce(chapter, 0), coalesce(story_order, 0), name) AS place FROM facts")
def render_order(spark, sf):
    w = W("char_id").orderBy(F.coalesce("chapter", F.lit(0)), F.coalesce("story_order", F.lit(0.0)), "name")
    return facts(spark, sf).select("node_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {EVIDENCE_SQL} SELECT node_id, string_agg(chunk_id, ',' ORDER BY coalesce(chapter, 0), coalesce(idx, 0), chunk_id) AS evidence FROM evidence GROUP BY node_id")
def evidence_order(spark, sf):
    e = evidence(spark, sf).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("chapter", F.lit(0)).alias("c"), F.coalesce("idx", F.lit(0)).alias("i"), "chunk_id"))).alias("e"))
    return e.select("node_id", F.array_join(F.transform("e", lambda x: x["chunk_id"].cast("string")), ",").alias("evidence"))


@query("SELECT label, count(*) AS n, count(chapter) AS with_chapter FROM (SELECT 'Event' AS label, o_orderkey AS id, year(o_orderdate) AS chapter FROM orders UNION ALL SELECT 'CharacterState', event_id, NULL FROM events) GROUP BY label")
def fact_layer(spark, sf):
    events = t(spark, sf, "orders").select(F.lit("Event").alias("label"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("chapter"))
    states = t(spark, sf, "events").select(F.lit("CharacterState").alias("label"), F.col("event_id").alias("id"))
    return events.unionByName(states, allowMissingColumns=True).groupBy("label").agg(F.count("*").alias("n"), F.count("chapter").alias("with_chapter"))


@query("SELECT l_partkey, l_suppkey, max(s) AS score FROM (SELECT l_partkey, l_suppkey, l_discount AS s FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, l_tax FROM lineitem) GROUP BY ALL")
def hybrid_union(spark, sf):
    lt = t(spark, sf, "lineitem")
    both = lt.select("l_partkey", "l_suppkey", F.col("l_discount").alias("s")).union(lt.select("l_partkey", "l_suppkey", F.col("l_tax").alias("s")))
    return both.groupBy("l_partkey", "l_suppkey").agg(F.max("s").alias("score"))


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE array_to_string(list_filter([p_name, p_brand, p_type], lambda x: x IS NOT NULL), '|') END AS u FROM part")
def ordered_union(spark, sf):
    u = F.array_distinct(F.concat(F.array("p_name", "p_brand"), F.array("p_brand", "p_type")))
    return t(spark, sf, "part").select("p_partkey", F.array_join(u, "|").alias("u"))


@query("SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_sets(spark, sf):
    a, b = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id")
    return a.subtract(b).select(F.lit("missing").alias("side"), "doc_id").union(b.subtract(a).select(F.lit("extra").alias("side"), "doc_id"))


@query("WITH own AS (SELECT DISTINCT c_nationkey AS k, c_acctbal > 0 AS p, 'n' || CAST(c_custkey % 40 AS VARCHAR) AS name FROM customer), other AS (SELECT DISTINCT s_nationkey AS k, 'n' || CAST(s_suppkey % 40 AS VARCHAR) AS name FROM supplier) SELECT k, name FROM (SELECT DISTINCT k, name FROM own) UNION ALL SELECT k, name FROM other o WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.k = o.k AND own.name = o.name)")
def relation_union(spark, sf):
    own = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("n"), F.col("c_custkey") % 40).alias("name")).distinct()
    other = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("n"), F.col("s_suppkey") % 40).alias("name")).distinct()
    return related_by_name(own, other, "k")
