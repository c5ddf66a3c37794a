"""Search, resolution, graph and context over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.bindings.base import EVIDENCE_SQL, FACTS_SQL, evidence, facts
from storyloom.bindings.rows import CONTEXT_SQL, held_passages
from storyloom.bindings.text import CHUNKS_SQL, chunk_rows, loose_sql
from storyloom.catalog import query, t
from storyloom.functions import rules
from storyloom.functions import text as X
from storyloom.operators import context as C
from storyloom.operators import graph as G
from storyloom.operators import resolution as R
from storyloom.operators import retrieval as Q
from storyloom.operators import search as S
from storyloom.operators import verdicts as V
from storyloom.operators.cells import VectorCells
from storyloom.operators.postings import Postings
from storyloom.sources.tables import kept, passing, shared_path

#: As search.WORD for text without Han, Hangul or kana, such as the driver's.
WORDS = r"([\p{L}\p{M}\p{N}]+)"


def vector_sql(p: str, nodes: str, asked: str, k: int) -> str:
    """{p}vt: what vector_topk gives for asked (query_id, vec, up_to) and nodes (node_id, vec, chapter)."""
    score = "list_cosine_similarity(q.vec, v.vec)"
    return f"""{p}vt AS (SELECT query_id, node_id, score FROM (SELECT q.query_id, v.node_id, {score} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round({score}, 9) DESC, v.node_id) AS r
FROM {asked} q, {nodes} v WHERE q.vec IS NOT NULL AND v.vec IS NOT NULL AND (q.up_to IS NULL OR v.chapter IS NULL OR v.chapter < q.up_to)) WHERE r <= {k})"""


def text_sql(p: str, nodes: str, asked: str, k: int) -> str:
    """{p}ft: what fulltext_topk gives for asked (query_id, text, up_to) and nodes (node_id, text, chapter)."""
    return f"""{p}w AS (SELECT node_id, unnest(regexp_extract_all(lower(text), '{WORDS}', 1)) AS term FROM {nodes}), {p}tf AS (SELECT node_id, term, count(*) AS tf FROM {p}w GROUP BY ALL), {p}sz AS (SELECT node_id, any_value(chapter) AS chapter, any_value(len) AS len FROM (SELECT node_id, count(*) AS len FROM {p}w GROUP BY 1) JOIN {nodes} USING (node_id) GROUP BY 1), {p}tot AS (SELECT count(*) AS n, avg(len) AS a FROM {p}sz),
{p}q AS (SELECT DISTINCT query_id, up_to, unnest(regexp_extract_all(lower(text), '{WORDS}', 1)) AS term FROM {asked}), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}sc AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM {p}q JOIN {p}df USING (term) JOIN {p}tf USING (term) JOIN {p}sz USING (node_id), {p}tot WHERE up_to IS NULL OR chapter IS NULL OR chapter < up_to GROUP BY 1, 2),
{p}ft AS (SELECT query_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM {p}sc) WHERE r <= {k})"""


def hybrid_sql(p: str, nodes: str, asked: str, k: int, wide: int = 10) -> str:
    """{p}hy: what search.searched gives."""
    scaled = "SELECT query_id, node_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM"
    return f"""{vector_sql(p, nodes, asked, wide)}, {text_sql(p, nodes, asked, wide)},
{p}hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, round(max(s), 6) AS score FROM ({scaled} {p}vt UNION ALL {scaled} {p}ft) GROUP BY 1, 2)) WHERE rank <= {k})"""


#: Requests: benchmark passages with the vector of their number. Nodes: documents with theirs, in the order of chapters.
ASKED_SQL = "asked AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS vec, NULL AS up_to FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"
NODES_SQL = "nodes AS (SELECT doc_id AS node_id, text, embedding::DOUBLE[] AS vec, doc_id AS chapter FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"


def asked_rows(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e, "query_id", "left")


def node_rows(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))
    return t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text", F.col("doc_id").alias("chapter")).join(e, "node_id", "left")


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec, NULL AS up_to FROM embeddings WHERE vec_id % 25 = 0), v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec, NULL AS chapter FROM embeddings), {vector_sql('', 'v', 'q', 5)} SELECT query_id, node_id, round(score, 6) AS score FROM vt")
def vector_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = S.vector_topk(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec")), 5)
    return hits.select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(f"WITH {ASKED_SQL}, {NODES_SQL}, {text_sql('', 'nodes', 'asked', 5)} SELECT query_id, node_id, score FROM ft")
def fulltext_topk(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return S.fulltext_topk(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs, 5).select("query_id", "node_id", "score")


@query(f"WITH {ASKED_SQL}, {NODES_SQL}, {text_sql('', 'nodes', 'asked', 5)} SELECT query_id, node_id, score FROM ft")
def fulltext_stored(spark, sf):
    """As fulltext_topk, from postings that two bundles have stored."""
    docs, index = t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"), Postings(spark, shared_path(spark, "postings"), 8)
    for half in (docs.where("node_id % 2 = 0"), docs.where("node_id % 2 <> 0")):
        index.add(half)
    return index.search(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5).select("query_id", "node_id", "score")


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec, NULL AS up_to FROM embeddings WHERE vec_id % 25 = 0), v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec, NULL AS chapter FROM embeddings), {vector_sql('', 'v', 'q', 5)} SELECT query_id, node_id, round(score, 6) AS score FROM vt")
def vector_stored(spark, sf):
    """As vector_topk, from cells that two bundles have stored."""
    e, index = t(spark, sf, "embeddings"), VectorCells(spark, shared_path(spark, "cells"))
    for half in (e.where("vec_id % 2 = 0"), e.where("vec_id % 2 <> 0")):
        index.add(half.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec")))
    hits = index.search(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 5)
    return hits.select("query_id", "node_id", F.round("score", 6).alias("score"))


HYBRID_SQL = """h AS (SELECT query_id, node_id, max(s) AS score FROM (SELECT l_partkey AS query_id, l_suppkey AS node_id, l_discount / nullif(max(l_discount) OVER (PARTITION BY l_partkey), 0) AS s FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, l_tax / nullif(max(l_tax) OVER (PARTITION BY l_partkey), 0) FROM lineitem) GROUP BY ALL)"""


@query(f"WITH {HYBRID_SQL} SELECT query_id, node_id, score FROM (SELECT query_id, node_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 6) DESC, node_id) AS r FROM h) WHERE r <= 3")
def hybrid_search(spark, sf):
    lt = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("node_id"), "l_discount", "l_tax")
    return S.hybrid(lt.withColumnRenamed("l_discount", "score").drop("l_tax"), lt.withColumnRenamed("l_tax", "score").drop("l_discount"), 3).select("query_id", "node_id", "score")


GRAPH_SQL = """m AS (SELECT l_orderkey AS k, unnest(['p' || l_partkey, 's' || l_suppkey, 'n' || s_nationkey, 'r' || a.n_regionkey, 'c' || o_custkey, 'n' || c_nationkey, 'r' || b.n_regionkey]) AS node FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation b ON b.n_nationkey = c_nationkey),
mem AS (SELECT DISTINCT k, node FROM m), e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
o1 AS MATERIALIZED (SELECT k, src, dst FROM mem JOIN e ON node = src), sub AS (SELECT k, src, dst FROM o1 WHERE (k, dst) IN (SELECT k, node FROM mem))"""


def graph_edges(spark, sf):
    edge = lambda a, x, b, y: [F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst")]
    e = t(spark, sf, "lineitem").where("l_linenumber = 1").select(*edge("p", "l_partkey", "s", "l_suppkey"))
    for name, cols in (("supplier", edge("s", "s_suppkey", "n", "s_nationkey")), ("customer", edge("c", "c_custkey", "n", "c_nationkey")), ("nation", edge("n", "n_nationkey", "r", "n_regionkey"))):
        e = e.union(t(spark, sf, name).select(*cols))
    return e.distinct()


#: Rows of chunks' facts that a slice of chunks has, and slices at most: what is exchanged at once is a slice's.
SLICE, SLICES = 1 << 20, 8


def subgraph_rows(spark, sf, keys=None):
    """(k, src, dst): facts of a chunk, their neighbours and all ancestors of these, then the edges inside that set. keys: (k) of the chunks to look at, else all.

    Members and candidates are many times the input, so chunks go through in slices, dealt by hash; only a slice's edges stay on disk.
    """
    lt = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), "o_custkey").alias("node"))
    if keys is not None:
        lt, o = lt.join(keys, "k", "left_semi"), o.join(keys, "k", "left_semi")
    edges = kept(graph_edges(spark, sf), "edges")
    up = G.ancestors(edges.where(~F.col("src").startswith("p")))
    slices, found = min(SLICES, 1 + lt.count() // SLICE), []
    for i in range(slices):
        mine = lambda df, i=i: df.where(F.pmod(F.xxhash64("k"), F.lit(slices)) == i)
        with passing(spark):
            near = mine(lt).select("k", F.explode(F.array("p", "s")).alias("node")).union(mine(o).join(mine(lt).select("k").distinct(), "k", "left_semi")).distinct()
            members = near.union(near.join(up, "node").select("k", F.col("ancestor").alias("node"))).distinct()
            found.append(kept(G.induced(members, edges, "k"), "subgraph", stays=True))
    return reduce(DataFrame.unionByName, found)


CHUNK_NODES_SQL = f"{CHUNKS_SQL}, nodes AS (SELECT c.doc_id * 100000 + c.chunk - 1 AS node_id, c.doc_id AS chapter, substr(text, start + 1, stop - start) AS text, embedding::DOUBLE[] AS vec FROM chunks c JOIN documents d USING (doc_id) LEFT JOIN embeddings ON vec_id = c.doc_id)"


@query(f"WITH RECURSIVE {CHUNK_NODES_SQL}, {ASKED_SQL}, {hybrid_sql('', 'nodes', 'asked', 5)}, {GRAPH_SQL}, g AS (SELECT k, count(*) AS edges FROM sub WHERE k IN (SELECT node_id // 100000 FROM hy) GROUP BY k) SELECT query_id, rank, node_id, chapter, md5(text) AS text_md5, score, coalesce(edges, 0) AS edges FROM hy JOIN nodes USING (node_id) LEFT JOIN g ON k = chapter")
def hybrid_chunks(spark, sf):
    """Hybrid search over chunks, five for each passage, with the size of the graph around each hit's facts; a chunk has its document's vector."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    chunks = chunk_rows(spark, sf).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("node_id"), "doc_id", F.col("doc_id").alias("chapter"), F.col("chunk_text").alias("text"))
    nodes = kept(chunks.join(e, "doc_id", "left"), "chunks")
    hits = kept(S.searched(asked_rows(spark, sf), nodes, 5), "hits")
    around = subgraph_rows(spark, sf, hits.select(F.floor(F.col("node_id") / 100000).alias("k")).distinct()).groupBy(F.col("k").alias("chapter")).agg(F.count("*").alias("edges"))
    return hits.join(nodes, "node_id").join(around, "chapter", "left").select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", "chapter", F.md5(F.col("text").cast("binary")).alias("text_md5"), "score", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(f"""WITH {CONTEXT_SQL}, {ASKED_SQL}, {NODES_SQL}, fnodes AS (SELECT nodes.node_id, text, vec, NULL AS chapter FROM nodes JOIN facts USING (node_id)), {hybrid_sql('', 'fnodes', 'asked', 5)}
SELECT query_id, node_id, est_chapter, n_evidence, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT 'P' || l_partkey AS p FROM evidence e WHERE e.node_id = hy.node_id)) AS related, (SELECT c_name FROM facts f JOIN customer ON c_custkey = f.char_id WHERE f.node_id = hy.node_id AND f.label = 'Event') AS participant FROM hy JOIN ctx USING (node_id)""")
def fact_search(spark, sf):
    """Hybrid search over facts, whose text and vector are those of the document of their number; for the five kept, chapter, participants and related things."""
    e, f = evidence(spark, sf), facts(spark, sf)
    nodes = node_rows(spark, sf).select("node_id", "text", "vec").join(f, "node_id")
    people = f.where("label = 'Event'").join(t(spark, sf, "customer").select(F.col("c_custkey").alias("char_id"), F.col("c_name").alias("person")), "char_id").select("node_id", F.col("person").alias("name"))
    related = e.select("node_id", F.concat(F.lit("P"), "l_partkey").alias("name"))
    established = e.where("l_partkey % 2 = 0").select("node_id", (F.col("chapter") + 1).alias("chapter"))
    found = Q.fact_search(asked_rows(spark, sf), nodes, established, e, people, related, 5)
    return found.select("query_id", "node_id", "est_chapter", "n_evidence", F.array_join("related", ",").alias("related"), F.col("people")[0].alias("participant"))


PAIRS_SQL = """pairs AS (SELECT a.p AS a, b.p AS b, round(1.0 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n), 1), 6) AS sim FROM
(SELECT p_brand AS k, p_name AS n, min(p_partkey) AS p FROM part GROUP BY ALL) a JOIN (SELECT p_brand AS k, p_name AS n, min(p_partkey) AS p FROM part GROUP BY ALL) b ON a.k = b.k AND a.p < b.p WHERE round(1.0 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n), 1), 6) >= 0.7)"""


def part_pairs(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), "p_brand")
    return S.fuzzy_pairs(p, X.name_similarity, 0.7, ["p_brand"])


@query(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def fuzzy_pairs(spark, sf):
    return part_pairs(spark, sf)


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.85")
def embedding_pairs(spark, sf):
    """Vectors of a label with a cosine of 0.85 or more."""
    return S.vector_pairs(t(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "label", F.col("embedding").alias("vec")), 0.85)


@query(f"""WITH {CONTEXT_SQL}, r AS (SELECT c_custkey AS query_id, c_name, c_nationkey FROM customer WHERE c_custkey % 100 = 0),
own AS (SELECT DISTINCT query_id, 'S' || l_suppkey AS name FROM r JOIN orders ON o_custkey = query_id JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1), oth AS (SELECT DISTINCT query_id, 'S' || l_suppkey AS name FROM r JOIN orders ON o_custkey = query_id JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2),
rel AS (SELECT query_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT query_id, name FROM own UNION SELECT query_id, name FROM oth) GROUP BY 1),
adj AS (SELECT char_id AS c, node_id FROM facts UNION SELECT char_id + 1, node_id FROM facts WHERE node_id % 10 = 0),
f AS (SELECT query_id, ctx.*, row_number() OVER (PARTITION BY query_id ORDER BY est_chapter, story_order NULLS LAST, ctx.name, ctx.node_id) AS rk FROM r JOIN adj ON c = query_id JOIN ctx USING (node_id) WHERE est_chapter <= 5)
SELECT query_id, 'profile' AS kind, query_id AS node_id, NULL AS chapter, 'n' || c_nationkey || ',r' || n_regionkey || ';' || coalesce(names, '') AS detail FROM r JOIN nation ON n_nationkey = c_nationkey LEFT JOIN rel USING (query_id)
UNION ALL SELECT query_id, 'fact', f.node_id, est_chapter, label || ';' || coalesce(customer.c_name, '') FROM f LEFT JOIN customer ON c_custkey = char_id WHERE rk <= 60""")
def entity_search(spark, sf):
    """Characters asked for by name or alias: a profile with relations and ancestors, and the first 60 facts next to them, up to a chapter, with who takes part."""
    c = t(spark, sf, "customer")
    known = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("c"), "c_custkey")).alias("aliases"))
    asked = c.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 200 == 0, F.col("c_name")).otherwise(F.concat(F.lit("c"), "c_custkey")).alias("asked"))
    f, e = facts(spark, sf), evidence(spark, sf)
    owner = F.concat(F.lit("c"), F.col("char_id"))
    names = t(spark, sf, "lineitem").where("l_linenumber <= 2").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_linenumber", F.concat(F.lit("c"), "o_custkey").alias("node_id"), F.concat(F.lit("S"), "l_suppkey").alias("name"))
    above = graph_edges(spark, sf).where(F.col("src").startswith("c") | F.col("src").startswith("n"))
    found = kept(Q.entity_search(asked, known, above, names.where("l_linenumber = 1"), names.where("l_linenumber = 2")), "found")
    number = F.substring("node_id", 2, 20).cast("long")
    profile = found.select("query_id", F.lit("profile").alias("kind"), number.alias("node_id"), F.lit(None).cast("int").alias("chapter"), F.concat(F.array_join("parents", ","), F.lit(";"), F.coalesce(F.array_join("related", ","), F.lit(""))).alias("detail"))
    fact = f.withColumn("node_id", F.concat(F.lit("f"), "node_id"))
    ev = e.withColumn("node_id", F.concat(F.lit("f"), "node_id"))
    edges = fact.select(owner.alias("src"), F.col("node_id").alias("dst")).union(fact.where(F.substring("node_id", -1, 1) == "0").select("node_id", F.concat(F.lit("c"), F.col("char_id") + 1)))
    people = fact.join(c.select(F.col("c_custkey").alias("char_id"), F.col("c_name").alias("who")), "char_id").select("node_id", F.col("who").alias("name"))
    near = Q.entity_facts(found, edges, fact, ev.where("l_partkey % 2 = 0").select("node_id", (F.col("chapter") + 1).alias("chapter")), ev, people, 5)
    return profile.union(near.select("query_id", F.lit("fact"), number, "est_chapter", F.concat_ws(";", "label", F.coalesce(F.array_join("people", ","), F.lit("")))))


CALLS_SQL = r"""cl AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN '' ELSE regexp_extract(text, '^([^ ]+)', 1) END AS a, CASE WHEN item_id % 4 = 0 THEN '' ELSE regexp_extract(text, ' ([^ ]+)', 1) END AS v, item_id * 20 + 100 AS up_to, embedding::DOUBLE[] AS vec FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
rt AS (SELECT item_id, vec, up_to, list_filter([CASE WHEN a = '' THEN 'h' || text END, CASE WHEN a = '' THEN 'f' || text END, CASE WHEN a <> '' THEN 'h' || a END, CASE WHEN a <> '' THEN 'f' || a END, CASE WHEN a <> '' AND v <> '' THEN 'h' || a || ': ' || v END, CASE WHEN a <> '' AND v <> '' THEN 'f' || a || ': ' || v END], lambda x: x IS NOT NULL) AS c FROM cl),
calls AS (SELECT item_id * 10 + generate_subscripts(c, 1) - 1 AS query_id, unnest(c) AS call, vec, up_to FROM rt), ha AS (SELECT query_id, substr(call, 2) AS text, vec, up_to FROM calls WHERE call[1] = 'h'), fa AS (SELECT query_id, substr(call, 2) AS text, vec, up_to FROM calls WHERE call[1] = 'f')"""
TURNS_SQL = "turns AS (SELECT (conv_id + 1) * 10000000 + turn AS node_id, text, conv_id AS chapter, embedding::DOUBLE[] AS vec FROM conversations LEFT JOIN embeddings ON vec_id = conv_id * 10 + turn)"


def routed_calls(spark, sf):
    """(query_id, tool, text, vec, up_to): the calls of every claim on both channels, each with its claim's own chapter."""
    axis = F.when(F.col("query_id") % 3 == 0, "").otherwise(F.regexp_extract("text", "^([^ ]+)", 1))
    value = F.when(F.col("query_id") % 4 == 0, "").otherwise(F.regexp_extract("text", " ([^ ]+)", 1))
    calls = asked_rows(spark, sf).select(F.col("query_id").alias("claim"), "vec", F.posexplode(rules.route_qav(axis, value, F.col("text"))).alias("channel", "c"))
    return calls.select((F.col("claim") * 10 + F.col("channel")).alias("query_id"), "c.tool", F.col("c.query_text").alias("text"), "vec", (F.col("claim") * 20 + 100).alias("up_to"))


@query(f"""WITH {CALLS_SQL}, {NODES_SQL}, {TURNS_SQL}, {hybrid_sql('h', 'nodes', 'ha', 3)}, {hybrid_sql('f', 'turns', 'fa', 3)},
hits AS (SELECT query_id, node_id, rank FROM hhy UNION ALL SELECT query_id, node_id, rank FROM fhy), tx AS (SELECT node_id, text FROM nodes UNION ALL SELECT node_id, text FROM turns)
SELECT query_id // 10 AS claim_id, query_id % 10 AS channel, node_id, rank, row_number() OVER (PARTITION BY query_id // 10, md5(regexp_replace(text, '\\s+', '', 'g')) ORDER BY query_id, rank) = 1 AS has_text FROM hits JOIN tx USING (node_id)""")
def claim_retrieve(spark, sf):
    """All claims at once: routed to their channels, both by words and vectors, cut at each claim's chapter before the three best are taken, repeated texts kept as references."""
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    turns = t(spark, sf, "conversations").withColumn("vec_id", F.col("conv_id") * 10 + F.col("turn")).join(e, "vec_id", "left")
    turns = turns.select(((F.col("conv_id") + 1) * 10000000 + F.col("turn")).alias("node_id"), "text", "vec", F.col("conv_id").alias("chapter"))
    calls = routed_calls(spark, sf).select(F.floor(F.col("query_id") / 10).alias("claim_id"), (F.col("query_id") % 10).alias("channel"), "tool", "text", "vec", "up_to")
    return Q.claim_retrieve(calls, node_rows(spark, sf).select("node_id", "text", "vec", "chapter"), turns, 3)


@query(rf"""WITH ra AS (SELECT item_id * 10 AS query_id, text, NULL AS up_to FROM benchmark UNION ALL SELECT item_id * 10 + 1, regexp_extract(text, '^([^ ]+)', 1) || ' ' || regexp_extract(text, ' ([^ ]+)', 1), NULL FROM benchmark), {NODES_SQL}, {text_sql('', 'nodes', 'ra', 5)},
h AS (SELECT query_id, doc_id, contains({loose_sql('d.text')}, {loose_sql('b.text')}) AS held FROM ft JOIN documents d ON doc_id = node_id JOIN benchmark b ON item_id = query_id // 10)
SELECT CASE WHEN query_id % 10 = 0 THEN 'quote' ELSE 'axis' END AS route, count(*) AS hits, count(DISTINCT query_id) FILTER (held) AS reached FROM h GROUP BY 1""")
def reach_by_route(spark, sf):
    """Two routings of the same claims, whole quote and first words, by how many passages their hits hold."""
    b = t(spark, sf, "benchmark")
    short = F.concat(F.regexp_extract("text", "^([^ ]+)", 1), F.lit(" "), F.regexp_extract("text", " ([^ ]+)", 1))
    asked = b.select((F.col("item_id") * 10).alias("query_id"), "text").union(b.select(F.col("item_id") * 10 + 1, short))
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    held = held_passages(spark, sf).select(F.col("doc_id").alias("node_id"), F.col("marker_id").alias("claim"), F.lit(True).alias("held"))
    h = S.fulltext_topk(asked, docs, 5).withColumn("claim", F.floor(F.col("query_id") / 10)).join(held, ["node_id", "claim"], "left")
    route = F.when(F.col("query_id") % 10 == 0, "quote").otherwise("axis")
    return h.groupBy(route.alias("route")).agg(F.count("*").alias("hits"), F.count_distinct(F.when(F.col("held"), F.col("query_id"))).alias("reached"))


# ---- graph


@query("SELECT 'c' || c_custkey AS node, unnest(['n' || n_nationkey, 'r' || n_regionkey]) AS ancestor FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def hierarchy_ancestors(spark, sf):
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return G.ancestors(c.union(n))


COMPONENT_SQL = f"{PAIRS_SQL}, l AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY a)"


@query(f"WITH RECURSIVE {COMPONENT_SQL} SELECT * FROM comp")
def merge_components(spark, sf):
    return S.merge_components(part_pairs(spark, sf))


@query("SELECT DISTINCT 'p' || (l_partkey - l_partkey % 10) AS src, l_returnflag AS type, CASE WHEN l_suppkey % 7 = 0 THEN 'p' || (l_partkey - l_partkey % 10) ELSE 's' || l_suppkey END AS dst FROM lineitem WHERE l_suppkey % 7 <> 0")
def rewire_edges(spark, sf):
    lt = t(spark, sf, "lineitem")
    part = F.concat(F.lit("p"), "l_partkey")
    e = lt.select(part.alias("src"), F.col("l_returnflag").alias("type"), F.when(F.col("l_suppkey") % 7 == 0, part).otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("dst"))
    canonical = lt.select(part.alias("node_id"), F.concat(F.lit("p"), F.col("l_partkey") - F.col("l_partkey") % 10).alias("component")).distinct()
    return G.rewire(e, canonical)


LABEL_SQL = "CASE p_size % 5 WHEN 0 THEN 'Item' WHEN 1 THEN 'Event' ELSE 'Character' END"


@query(f"""WITH RECURSIVE nd AS (SELECT p_partkey AS id, p_brand AS tenant, {LABEL_SQL} AS label, CASE WHEN p_size % 5 = 0 AND p_partkey % 2 = 0 THEN '<' || p_name || '>' ELSE p_name END AS name FROM part),
ky AS (SELECT *, CASE label WHEN 'Character' THEN name WHEN 'Item' THEN replace(replace(replace(name, '<', ''), '>', ''), ' ', '') ELSE 'n' || id END AS k FROM nd), mn AS (SELECT tenant, label, k, min(id) AS m FROM ky GROUP BY ALL),
pr AS (SELECT a.m AS a, b.m AS b FROM mn a JOIN mn b ON a.tenant = b.tenant AND a.label = 'Character' AND b.label = 'Character' AND a.m <> b.m WHERE round(1.0 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k), 1), 6) >= 0.7),
reach AS (SELECT a, a AS b FROM pr UNION SELECT r.a, p.b FROM reach r JOIN pr p ON p.a = r.b), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT id AS node_id, label, coalesce(c, m) AS canonical FROM ky JOIN mn USING (tenant, label, k) LEFT JOIN comp ON a = m""")
def resolve_entities(spark, sf):
    """Parts as nodes of a tenant's labels: characters by likeness and merge sets, items by spelling, events never. The likeness is that of edits here, as SQL has no other; index_chapters takes the weighted one."""
    size = F.col("p_size") % 5
    name = F.when((size == 0) & (F.col("p_partkey") % 2 == 0), F.concat(F.lit("<"), "p_name", F.lit(">"))).otherwise(F.col("p_name"))
    nodes = t(spark, sf, "part").select(F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("node_id"), F.when(size == 0, "Item").when(size == 1, "Event").otherwise("Character").alias("label"), name.alias("name"))
    return R.resolve(nodes, lambda new, all_: R.edit_pairs(new, all_, X.name_similarity, 0.7)).select("node_id", "label", "canonical")


@query("SELECT DISTINCT o_orderkey AS node_id, unnest(['c' || o_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) AS neighbor FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def fact_neighbors(spark, sf):
    one = t(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"), "o_custkey")
    two = one.join(t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    up = two.join(t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    return up.select("node_id", F.explode(F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("neighbor")).distinct()


@query(f"WITH {GRAPH_SQL} SELECT k, src, dst FROM sub")
def chunk_subgraph(spark, sf):
    return subgraph_rows(spark, sf)


#: Nations as tenants: customers are characters, finished orders their states, open ones events at one of four places, suppliers organisations.
CONTEXT_TEXT_SQL = """cu AS (SELECT c_custkey, c_nationkey AS k, c_name AS name, o.* FROM customer LEFT JOIN orders o ON o_custkey = c_custkey),
st AS (SELECT k, name AS owner, o_orderkey % 7 <> 0 AS owned, c_custkey, 's' || o_orderkey AS name, CASE o_orderkey % 3 WHEN 1 THEN 1 + k % 5 WHEN 0 THEN year(o_orderdate) - 1991 END AS ch, CASE WHEN o_orderkey % 4 = 0 THEN 'item' || o_orderkey % 3 END AS about FROM cu WHERE o_orderstatus = 'F'),
sl AS (SELECT *, name || CASE WHEN ch IS NULL AND about IS NULL THEN '' ELSE ' (' || concat_ws(', ', ch || '화 성립', '대상: ' || about) || ')' END AS said FROM st),
ns AS (SELECT c_custkey, string_agg(chr(10) || '  · 상태: ' || said, '' ORDER BY coalesce(ch, 0), name) AS nested FROM sl WHERE owned GROUP BY 1),
lines AS (SELECT c_nationkey AS k, 1 AS section, 1 AS rank, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, c_name AS name, 'c' || c_custkey AS id, '- (Character) ' || c_name || CASE WHEN c_custkey % 10 = 0 THEN ' — aliases=c' || c_custkey ELSE '' END || coalesce(nested, '') || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || '  · 관계: KNOWS → Item:item0' ELSE '' END AS line FROM customer LEFT JOIN ns USING (c_custkey)
UNION ALL SELECT k, 1, 2, 0, 0, name, name, '- (CharacterState, 소유자 미상) ' || said FROM sl WHERE NOT owned
UNION ALL SELECT k, 2, 1, year(o_orderdate) - 1991, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 10) / 10 END, 'e' || o_orderkey, 'e' || o_orderkey, '- (Event) e' || o_orderkey || ' (' || (year(o_orderdate) - 1991) || '화' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' #' || ((o_orderkey % 10) / 10) END || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ', 장소: place' || o_orderkey % 4 END || ', 참여: ' || name || ')' FROM cu WHERE o_orderstatus = 'O'
UNION ALL SELECT n_nationkey, 2, 1, 1 + n_nationkey % 5, 0, 'founding', 'ev' || n_nationkey, '- (Event) founding (' || (1 + n_nationkey % 5) || '화)' FROM nation
UNION ALL SELECT n_nationkey, 3, 1, 0, 0, 'Location' || chr(1) || 'place' || j, 'l' || n_nationkey || '-' || j, '- (Location) place' || j || CASE WHEN j > 0 THEN ' (상위: place0)' ELSE '' END FROM nation, range(4) r(j)
UNION ALL SELECT n_nationkey, 3, 1, 0, 0, 'Item' || chr(1) || 'item' || j, 'i' || n_nationkey || '-' || j, '- (Item) item' || j FROM nation, range(3) r(j)
UNION ALL SELECT s_nationkey, 3, 1, 0, 0, 'Organization' || chr(1) || s_name, 'o' || s_suppkey, '- (Organization) ' || s_name FROM supplier
UNION ALL SELECT DISTINCT c_nationkey, 1, 0, 0, 0, '', '', '## 인물' FROM customer UNION ALL SELECT n_nationkey, 2, 0, 0, 0, '', '', '## 사건' FROM nation UNION ALL SELECT n_nationkey, 3, 0, 0, 0, '', '', '## 사물·장소·조직' FROM nation),
gt AS (SELECT k, string_agg(line, chr(10) ORDER BY section, rank, a, b, name, id, line) AS text FROM lines GROUP BY k)"""


def nation_graph(spark, sf):
    """(nodes, edges) of nations as tenants, as operators.context takes them."""
    cust = t(spark, sf, "customer").select(F.col("c_nationkey").alias("tenant"), F.concat(F.lit("c"), "c_custkey").alias("c"), "c_custkey", "c_name")
    o = t(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    year, key, no = F.year("o_orderdate") - 1991, F.col("o_orderkey"), lambda kind: F.lit(None).cast(kind)
    row = lambda df, i, label, name, chapter=None, order=None, extras=None: df.select("tenant", i.alias("node_id"), F.lit(label).alias("label"), name.alias("name"), (no("int") if chapter is None else chapter.cast("int")).alias("chapter"), (no("double") if order is None else order.cast("double")).alias("story_order"), (F.lit("") if extras is None else extras).alias("extras"))
    edge = lambda df, a, kind, b: df.select("tenant", a.alias("src"), F.lit(kind).alias("type"), b.alias("dst"))
    nation = t(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant"))
    places = nation.select("tenant", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    own = lambda letter, j: F.concat(F.lit(letter), "tenant", F.lit("-"), j)
    state, event, founding = F.concat(F.lit("s"), key), F.concat(F.lit("e"), key), F.concat(F.lit("ev"), "tenant")
    done, open_ = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")
    nodes = [
        row(cust, F.col("c"), "Character", F.col("c_name"), extras=F.when(F.col("c_custkey") % 10 == 0, rules.extras(F.create_map(F.lit("name"), F.col("c_name"), F.lit("aliases"), F.col("c")), ["name"])).otherwise("")),
        row(done, state, "CharacterState", state, F.when(key % 3 == 0, year)), row(open_, event, "Event", event, year, F.when(key % 5 != 0, (key % 10) / 10)),
        row(nation, founding, "Event", F.lit("founding"), 1 + F.col("tenant") % 5), row(places, own("l", "j"), "Location", F.concat(F.lit("place"), "j")), row(places.where("j < 3"), own("i", "j"), "Item", F.concat(F.lit("item"), "j")),
        row(t(spark, sf, "supplier").withColumnRenamed("s_nationkey", "tenant"), F.concat(F.lit("o"), "s_suppkey"), "Organization", F.col("s_name")),
    ]
    edges = [
        edge(done.where(key % 7 != 0), F.col("c"), "HAS_STATE", state), edge(done.where(key % 3 == 1), state, "ESTABLISHED_IN", founding), edge(done.where(key % 4 == 0), state, "ABOUT", own("i", key % 3)),
        edge(open_, F.col("c"), "APPEARS_IN", event), edge(open_.where(key % 6 != 0), own("l", key % 4), "HOSTS", event), edge(places.where("j > 0"), own("l", "j"), "LOCATED_IN", own("l", F.lit(0))), edge(cust.where("c_custkey % 5 = 0"), F.col("c"), "KNOWS", own("i", F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


@query(f"WITH {CONTEXT_TEXT_SQL} SELECT k, md5(text) AS text_md5 FROM gt")
def graph_context(spark, sf):
    """All that a tenant's graph holds as text: characters with states, states that nobody has, events, things, other relations."""
    return C.graph_text(*nation_graph(spark, sf)).select(F.col("tenant").alias("k"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


DOC_SQL = f"""{FACTS_SQL}, {EVIDENCE_SQL}, ck AS (SELECT DISTINCT f.char_id AS k, 'C' || e.chunk_id AS alias, e.chapter, e.idx FROM facts f JOIN evidence e USING (node_id)),
ev AS (SELECT node_id, string_agg(DISTINCT 'C' || chunk_id, ' ' ORDER BY 'C' || chunk_id) AS c, string_agg(DISTINCT 'P' || l_partkey || '(Item)', ', ' ORDER BY 'P' || l_partkey || '(Item)') AS rel FROM evidence GROUP BY 1),
dl AS (SELECT k, 1 AS section, 1 AS rank, alias AS name, alias || ' (' || chapter || '화#' || idx || ') ' AS line FROM ck
UNION ALL SELECT char_id, 2, 1, 'F' || node_id, 'F' || node_id || ' (' || label || ' · ' || coalesce(chapter::VARCHAR, '-') || '화' || coalesce(' · 순서 ' || story_order, '') || ') ' || name || CASE WHEN label = 'Event' THEN chr(10) || '     참가자: ' || c_name ELSE '' END || coalesce(chr(10) || '     연관: ' || rel, '') || coalesce(chr(10) || '     근거: ' || c, '') FROM facts f JOIN customer ON c_custkey = char_id LEFT JOIN ev USING (node_id)
UNION ALL SELECT c_custkey, 3, 1, 'E' || c_custkey, 'E' || c_custkey || ' (Character) ' || c_name || ' [별칭: c' || c_custkey || ']' || chr(10) || '     상위: ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT char_id FROM facts)),
jb AS (SELECT DISTINCT char_id AS k FROM facts), cl AS (SELECT char_id AS k, node_id % 100000 AS n, node_id FROM facts WHERE chapter = 3),
al AS (SELECT * FROM dl UNION ALL SELECT k, 1, 0, '', '[문서고 · 원문 청크]' FROM jb UNION ALL SELECT k, 2, 0, '', chr(10) || '[문서고 · 사실]' FROM jb UNION ALL SELECT k, 3, 0, '', chr(10) || '[문서고 · 개체]' FROM jb WHERE k % 2 = 0),
rf AS (SELECT k, 4 AS section, n AS rank, '' AS name, 'P' || n || ' "q' || n || '" (axis / v) [줄 ' || n || ', ' || (n + 1) || ']  → ' || coalesce(c, '-') || ' | F' || node_id || CASE WHEN k % 2 = 0 THEN ' | E' || k ELSE '' END AS line FROM cl LEFT JOIN ev USING (node_id) UNION ALL SELECT DISTINCT k, 4, -1, '', '[claim별 참조]' FROM cl)"""


@query(f"WITH {DOC_SQL} SELECT k, md5(string_agg(line, chr(10) ORDER BY section, rank, name, line)) AS text_md5 FROM (SELECT * FROM al UNION ALL SELECT * FROM rf) GROUP BY k")
def context_document(spark, sf):
    """The sources of a character's claims: chunks, facts with people, things and evidence, the character itself for every second one, and what each claim refers to."""
    f, job = facts(spark, sf), F.col("char_id").alias("job")
    e = kept(evidence(spark, sf).join(f.select("node_id", job), "node_id"), "evidence")
    alias = F.concat(F.lit("C"), "chunk_id")
    chunks = e.select("job", alias.alias("alias"), "chapter", "idx", F.lit("").alias("text")).distinct()
    per = e.groupBy("node_id").agg(F.collect_set(alias).alias("evidence"), F.array_sort(F.collect_set(F.concat(F.lit("P"), "l_partkey", F.lit("(Item)")))).alias("related"))
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    none = F.array().cast("array<string>")
    rows = f.join(c, F.col("char_id") == F.col("c_custkey")).join(per, "node_id", "left")
    known = rows.select(job, F.concat(F.lit("F"), "node_id").alias("alias"), "label", "chapter", "story_order", "name", F.lit("").alias("description"), F.when(F.col("label") == "Event", F.array("c_name")).otherwise(none).alias("participants"), F.coalesce("related", none).alias("related"), F.coalesce("evidence", none).alias("evidence"))
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    who = c.where("c_custkey % 2 = 0").join(f.select(F.col("char_id").alias("c_custkey")).distinct(), "c_custkey", "left_semi").join(n, "c_nationkey")
    who = who.select(F.col("c_custkey").alias("job"), F.concat(F.lit("E"), "c_custkey").alias("alias"), F.lit("Character").alias("label"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("c"), "c_custkey")).alias("aliases"), F.lit("").alias("description"), none.alias("related"), F.array("n_name").alias("parents"))
    asked = f.where("chapter = 3").select(job, (F.col("node_id") % 100000).alias("n"), "node_id")
    claims = asked.select("job", "n", F.concat(F.lit("P"), "n").alias("claim_id"), F.concat(F.lit("q"), "n").alias("quote"), F.lit("axis / v").alias("described"), F.array("n", F.col("n") + 1).alias("lines"))
    refs = asked.select("job", "n", F.lit("F").alias("kind"), F.concat(F.lit("F"), "node_id").alias("alias")).unionByName(asked.join(e.drop("job"), "node_id").select("job", "n", F.lit("C").alias("kind"), alias.alias("alias")))
    refs = refs.unionByName(asked.where("job % 2 = 0").select("job", "n", F.lit("E").alias("kind"), F.concat(F.lit("E"), "job").alias("alias")))
    at = lambda df, a: df.select("job", "section", F.struct(F.col(f"place.{a}").cast("long").alias("rank"), F.col("place.name").alias("name")).alias("place"), "line")
    lines = at(C.source_lines(chunks, known, who), "rank").unionByName(at(C.reference_lines(claims, refs), "n"))
    return C.text_of(lines, "job").select(F.col("job").alias("k"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {CONTEXT_TEXT_SQL}, sm AS (SELECT c_nationkey AS k, year(o_orderdate) - 1991 AS chapter, 'orders ' || count(*) AS summary FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 4 <> 1 GROUP BY ALL),
rc AS (SELECT k, string_agg('[' || chapter || '화] ' || summary, chr(10) ORDER BY chapter) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY chapter DESC) AS r FROM sm) WHERE r <= 3 GROUP BY k)
SELECT k, md5(concat_ws(chr(10) || chr(10), CASE WHEN n_nationkey % 3 <> 0 THEN '# 지금까지의 전체 줄거리(압축)' || chr(10) || n_name END, '# 최근 회차 요약' || chr(10) || recent, '# 지금까지의 그래프' || chr(10) || text)) AS bundle_md5 FROM gt JOIN nation ON n_nationkey = k LEFT JOIN rc USING (k)""")
def novel_context(spark, sf):
    """The story so far, the last three chapters and the graph, for each tenant; empty parts are left out."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise("").alias("summary"))
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 4 <> 1")
    s = o.groupBy(F.col("c_nationkey").alias("tenant"), (F.year("o_orderdate") - 1991).alias("chapter")).agg(F.concat(F.lit("orders "), F.count("*")).alias("summary"))
    return C.story_context(n, s, C.graph_text(*nation_graph(spark, sf))).select(F.col("tenant").alias("k"), F.md5(F.col("context").cast("binary")).alias("bundle_md5"))


VOTES_SQL = """cl AS (SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, list_sort([event_id % 11, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(10, event_id % 13) END, greatest(0, event_id % 9 - 1)])[2] AS score FROM events)"""


@query(f"WITH {EVIDENCE_SQL}, {VOTES_SQL} SELECT job_id, 'P' || n AS claim_id, CAST(score AS INT) AS score, CASE WHEN event_id % 6 IN (1, 2, 3) THEN CAST(event_id % 6 AS VARCHAR) ELSE '1,2,3' END AS lines, (SELECT string_agg(c, ',' ORDER BY chapter, idx) FROM (SELECT chapter, idx, min(chunk_id) AS c FROM evidence v WHERE v.node_id = event_id GROUP BY ALL)) AS cited FROM cl WHERE score >= 7")
def detect_contradictions(spark, sf):
    """From claims and three samples of verdict JSON to findings: parsed, clamped, voted, cut at the threshold, with valid lines and resolved citations."""
    e = F.col("event_id")
    claims = t(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    claims = kept(claims, "claims")
    samples = F.array((e % 11).cast("string"), F.when(e % 7 == 0, "high").otherwise((e % 13).cast("string")), (e % 9 - 1).cast("string"))
    one = F.struct(F.concat(F.lit("P"), "n").alias("claimId"), F.col("score"), F.array((e % 6).cast("int")).alias("lineIds"), F.array(F.concat(F.lit("F"), "event_id"), F.lit("X9")).alias("cited"))
    # A reply holds the verdicts of ten claims of a job.
    replies = claims.select("job_id", "n", "event_id", F.posexplode(samples).alias("sample", "score")).groupBy("job_id", "sample", F.floor(F.col("n") / 10).alias("batch")).agg(F.to_json(F.struct(F.collect_list(one).alias("verdicts"))).alias("raw"))
    known = evidence(spark, sf).join(claims.select("event_id", F.col("job_id").alias("job")), F.col("node_id") == F.col("event_id"))
    known = known.select("job", F.concat(F.lit("F"), "node_id").alias("alias"), "chunk_id", "chapter", "idx")
    asked = claims.select(F.col("job_id").alias("job"), "n", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("lines"))
    found = V.findings(asked, replies.withColumnRenamed("job_id", "job"), known)
    return found.select(F.col("job").alias("job_id"), "claim_id", "score", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join(F.col("chunks").cast("array<string>"), ",").alias("cited"))


@query("""WITH RECURSIVE h AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation WHERE n_nationkey <> (n_nationkey * 2 + 1) % 25), reach AS (SELECT a, b FROM h UNION SELECT r.a, h.b FROM reach r JOIN h ON r.b = h.a), k AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1)
SELECT 'orphan' AS problem, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'dangling', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) UNION ALL SELECT 'loop', count(*) FROM lineitem WHERE l_partkey = l_suppkey
UNION ALL SELECT 'one_sided', count(*) FROM k WHERE a <> b AND NOT EXISTS (SELECT 1 FROM k x WHERE x.a = k.b AND x.b = k.a) UNION ALL SELECT 'cycle', count(DISTINCT a) FROM reach WHERE a = b""")
def graph_audit(spark, sf):
    lt = t(spark, sf, "lineitem")
    orphan = t(spark, sf, "orders").join(lt, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    dangling = lt.join(t(spark, sf, "part").where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    known = lt.where("l_linenumber = 1 AND l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    back = known.select(F.col("b").alias("a"), F.col("a").alias("b"))
    up = t(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    found = {"orphan": orphan, "dangling": dangling, "loop": lt.where("l_partkey = l_suppkey"), "one_sided": known.join(back, ["a", "b"], "left_anti"), "cycle": G.on_cycles(up)}
    out = None
    for name, rows in found.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = n if out is None else out.union(n)
    return out
