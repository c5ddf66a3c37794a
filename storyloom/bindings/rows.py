"""Sources, projections, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.bindings.base import EVIDENCE_SQL, FACTS_SQL, evidence, facts
from storyloom.bindings.text import LINES_SQL, loose_sql
from storyloom.catalog import query, t
from storyloom.functions import rules
from storyloom.functions import text as X
from storyloom.operators import joins as J
from storyloom.operators.indexing import parsed
from storyloom.sources import artifacts as R
from storyloom.sources.tables import shared_path


@query("SELECT doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN 'Chapter ' || doc_id ELSE '' END AS title, md5(text) AS content_md5 FROM documents WHERE doc_id % 100 = 0")
def src_manuscript(spark, sf):
    """A table of requests (work, number) looked up among all manuscripts."""
    d = t(spark, sf, "documents").select("source", F.col("doc_id").alias("number"), "text")
    asked = t(spark, sf, "documents").where("doc_id % 100 = 0").select("source", F.col("doc_id").alias("number"))
    return J.in_scope(d, asked, "source", "number").select("number", F.when(F.col("number") % 2 == 0, F.concat(F.lit("Chapter "), "number")).otherwise("").alias("title"), F.md5(F.col("text").cast("binary")).alias("content_md5"))


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), 'untitled') AS title, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || ' … (total ' || length(text) || ')' ELSE text END AS preview FROM documents")
def manuscript_preview(spark, sf):
    d, n = t(spark, sf, "documents"), F.length("text")
    return d.select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), F.lit("untitled")).alias("title"), F.when(n > 4000, F.concat(F.substring("text", 1, 4000), F.lit(" … (total "), n, F.lit(")"))).otherwise(F.col("text")).alias("preview"))


@query("SELECT source AS work_id, coalesce(max(lang) FILTER (doc_id % 50 = 0), 'untitled') AS title FROM documents GROUP BY source")
def src_work(spark, sf):
    return t(spark, sf, "documents").groupBy(F.col("source").alias("work_id")).agg(F.coalesce(F.max(F.when(F.col("doc_id") % 50 == 0, F.col("lang"))), F.lit("untitled")).alias("title"))


KIND_SQL = "CASE WHEN item_id % 3 > 0 THEN 'error' WHEN item_id % 2 = 0 THEN 'hard_negative' ELSE 'excluded' END"


@query(f"""SELECT kind, 'v' || d AS draft, CASE WHEN kind = 'error' THEN 'v' || d || '-GT' || row_number() OVER (PARTITION BY d, kind ORDER BY item_id) END AS gid, text AS quote FROM (SELECT *, item_id % 5 + 1 AS d, {KIND_SQL} AS kind FROM benchmark)
UNION ALL SELECT 'broken', NULL, NULL, 'odd.gt.json'""")
def src_ground_truth(spark, sf):
    """A directory of drafts' files of JSON, written and read back: errors with ids by draft and place, hard negatives, excluded ones, and a file that is no JSON."""
    item = F.col("item_id")
    kind = F.when(item % 3 > 0, "errors").when(item % 2 == 0, "hard_negatives").otherwise("excluded")
    b = t(spark, sf, "benchmark").select(F.concat(F.lit("v"), item % 5 + 1).alias("draft"), kind.alias("kind"), "item_id", "text")
    lists = b.groupBy("draft").pivot("kind", ["errors", "hard_negatives", "excluded"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.struct(x["text"].alias("quote"))))
    files = lists.select(F.concat("draft", F.lit(".gt.json")).alias("name"), F.to_json(F.struct("draft", "errors", "hard_negatives", "excluded"), {"pretty": "true"}).alias("body"))
    odd = spark.range(1).select(F.lit("odd.gt.json").alias("name"), F.lit('{"errors": [').alias("body"))
    truths, broken = R.ground_truth(spark, R.put_named(files.union(odd), shared_path(spark, "drafts")))
    return truths.select("kind", "draft", "gid", "quote").union(broken.select(F.lit("broken"), F.lit(None), F.lit(None), "file_name"))


RUNS_SQL = "f AS (SELECT o_orderkey % 40 AS run, o_orderstatus AS draft, count(*) AS n FROM orders GROUP BY ALL)"


@query(f"WITH {RUNS_SQL} SELECT 'r' || run AS run FROM f WHERE n % 5 > 0 GROUP BY run HAVING count(*) = (SELECT count(DISTINCT draft) FROM f)")
def runs_complete(spark, sf):
    """A directory of runs' files; the runs that have evidence for every draft, by the names of their files alone."""
    f = t(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("run"), F.col("o_orderstatus").alias("draft")).agg(F.count("*").alias("n"))
    f = f.select(F.concat(F.lit("r"), "run").alias("run"), "draft", "n")
    name = lambda stage: F.concat_ws("_", F.lit(stage), "run", F.concat("draft", F.lit(".json")))
    body = F.to_json(F.struct("run", "draft", "n")).alias("body")
    files = f.select(name("claims").alias("name"), body).union(f.where("n % 5 > 0").select(name("evidence").alias("name"), body))
    return R.complete_runs(spark, R.put_named(files, shared_path(spark, "runs")), f.select("draft"))


@query("SELECT doc_id, sha1(source || '|' || lang || '|' || text) AS request FROM documents WHERE sha1(source || '|' || lang || '|' || text) NOT IN (SELECT sha1(source || '|' || lang || '|' || text) FROM documents WHERE doc_id % 3 = 0)")
def pending_requests(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha1(F.concat_ws("|", "source", "lang", "text")).alias("request"))
    return d.join(d.where("doc_id % 3 = 0").select("request").distinct(), "request", "left_anti").select("doc_id", "request")


@query("SELECT conv_id AS job_id, turn AS episode_id, CASE WHEN length(text) % 5 = 0 THEN 'ERROR' ELSE 'DONE' END AS status FROM conversations")
def job_chapters(spark, sf):
    c = t(spark, sf, "conversations").withColumn("status", F.when(F.length("text") % 5 == 0, "ERROR").otherwise("DONE"))
    jobs = c.groupBy(F.col("conv_id").alias("job_id")).agg(F.collect_list(F.struct(F.col("turn").alias("episode_id"), "status")).alias("episodes"))
    return jobs.select("job_id", F.inline("episodes"))


@query("SELECT user_id || '' AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def job_status_latest(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("SELECT o_orderkey, o_custkey || ':' || o_orderkey AS tenant_id, 'u' || o_custkey || 'w' || o_orderkey AS tenant_ft FROM orders")
def tenant_key(spark, sf):
    u, w = F.col("o_custkey"), F.col("o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", rules.tenant_id(u, w).alias("tenant_id"), rules.tenant_ft(u, w).alias("tenant_ft"))


@query("SELECT source, count(*) AS n, max(doc_id) AS latest FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 100 = 0) GROUP BY source")
def tenant_scope(spark, sf):
    """Only the tenants that somebody asks for are read, then summed up each for itself."""
    d = t(spark, sf, "documents").select("source", "doc_id")
    return J.in_scope(d, d.where("doc_id % 100 = 0"), "source").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))


@query(f"WITH {FACTS_SQL} SELECT node_id, chapter FROM facts WHERE chapter IS NULL OR chapter < 4")
def cutoff_strict_keep_null(spark, sf):
    return facts(spark, sf).where(rules.before_chapter(F.col("chapter"), 4)).select("node_id", "chapter")


@query(f"""WITH {FACTS_SQL}, r AS (SELECT event_id AS query_id, user_id AS char_id, event_id % 9 - 1 AS up_to FROM events)
SELECT query_id, (SELECT node_id FROM facts f WHERE f.char_id = r.char_id AND (f.chapter IS NULL OR f.chapter < r.up_to) ORDER BY chapter DESC NULLS LAST, story_order DESC NULLS LAST, node_id DESC LIMIT 1) AS node_id FROM r""")
def state_as_of(spark, sf):
    """The last fact of a character before each request's own chapter; those of unknown chapters lie before all."""
    asked = t(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("char_id"), (F.col("event_id") % 9 - 1).cast("int").alias("up_to"))
    return J.state_as_of(asked, facts(spark, sf), "char_id", ["node_id"], ["story_order", "node_id"]).select("query_id", "node_id")


@query(f"WITH {FACTS_SQL} SELECT node_id, chapter FROM facts WHERE chapter <= 4")
def cutoff_inclusive(spark, sf):
    return facts(spark, sf).where(rules.up_to_chapter(F.col("chapter"), 4)).select("node_id", "chapter")


@query("SELECT event_id FROM events WHERE TRY_CAST(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') || '화' END AS INT) IS NULL OR CAST(json_extract_string(props, '$.k') AS INT) < 50")
def exclude_future(spark, sf):
    k = F.get_json_object("props", "$.k")
    return t(spark, sf, "events").where(rules.not_future(F.when(F.col("event_id") % 3 == 0, k).otherwise(F.concat(k, F.lit("화"))), 50)).select("event_id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'Node' ELSE p_brand END AS label FROM part")
def domain_label(spark, sf):
    meta = F.lit("__Entity__")
    labels = F.when(F.col("p_size") % 3 == 0, F.array(meta, F.col("p_type"))).when(F.col("p_size") % 3 == 1, F.array(meta, F.lit("Fact"))).otherwise(F.array(F.lit("Chunk"), F.col("p_brand"), F.col("p_type")))
    return t(spark, sf, "part").select("p_partkey", rules.domain_label(labels).alias("label"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 NOT IN (0, 1) AND r_regionkey <> 2")
def domain_nodes(spark, sf):
    """Edges whose two ends are the story's own: nations and regions with labels, some of them meta labels."""
    label = F.when(F.col("n_nationkey") % 5 == 0, "Chunk").when(F.col("n_nationkey") % 5 == 1, "Chapter").otherwise("Location")
    n = t(spark, sf, "nation").where(~label.isin(rules.META_LABELS))
    r = t(spark, sf, "region").where(~F.when(F.col("r_regionkey") == 2, "Story").otherwise("Location").isin(rules.META_LABELS))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("""SELECT 'edge' AS kind, sha256(n_regionkey || '#1#n' || n_nationkey) AS a, sha256(n_regionkey || '#1#r' || n_regionkey) AS b, 'LOCATED_IN' AS what, 1::BIGINT AS n FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey <> 4
UNION ALL SELECT 'node', sha256(n_regionkey || '#1#n' || n_nationkey), NULL, n_name, 1 FROM nation UNION ALL SELECT 'node', sha256(r_regionkey || '#1#r' || r_regionkey), NULL, r_name, 1 FROM region WHERE r_regionkey <> 4
UNION ALL SELECT 'pruned', NULL, NULL, 'label', count(*) FROM region UNION ALL SELECT 'pruned', NULL, NULL, 'no_property', count(*) FROM region UNION ALL SELECT 'pruned', NULL, NULL, 'property', count(*) FROM nation
UNION ALL SELECT 'pruned', NULL, NULL, 'dangling', count(*) FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'pruned', NULL, NULL, 'pattern', count(*) FROM nation WHERE n_nationkey % 4 = 0 AND n_regionkey <> 4""")
def schema_prune(spark, sf):
    """What a region's extraction may keep: known labels and properties, edges of the allowed patterns with both ends there; the rest is counted by reason."""
    node = lambda i, label, *props: F.struct(i.alias("id"), F.lit(label).alias("label"), F.create_map(*props).cast("map<string,string>").alias("properties"))
    edge = F.struct(F.when(F.col("n_nationkey") % 4 == 0, "PART_OF").otherwise("LOCATED_IN").alias("type"), F.concat(F.lit("n"), "n_nationkey").alias("start_node_id"), F.concat(F.lit("r"), "n_regionkey").alias("end_node_id"))
    own = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(node(F.concat(F.lit("n"), "n_nationkey"), "Location", F.lit("name"), F.col("n_name"), F.lit("people"), F.lit("9"))).alias("nodes"), F.collect_list(edge).alias("relationships"))
    more = F.array(node(F.lit("m"), "Mood", F.lit("name"), F.lit("dark")), node(F.lit("i"), "Item", F.lit("people"), F.lit("9")))
    region = F.when(F.col("r_regionkey") != 4, F.array(node(F.concat(F.lit("r"), "r_regionkey"), "Location", F.lit("name"), F.col("r_name")))).otherwise(F.array())
    raw = own.join(t(spark, sf, "region"), "r_regionkey").select(F.col("r_regionkey").cast("string").alias("tenant"), F.lit(1).alias("chapter"), F.to_json(F.struct(F.concat("nodes", more, region).alias("nodes"), "relationships")).alias("raw"))
    nodes, edges, pruned = parsed(raw)
    one, no = F.lit(1).cast("long").alias("n"), F.lit(None).cast("string")
    out = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("what"), one)
    out = out.union(nodes.select(F.lit("node"), "node_id", no, "name", one))
    # An item without its one property has none left, so the property is not counted once more.
    return out.union(pruned.groupBy("reason").agg(F.sum("n").alias("n")).select(F.lit("pruned"), no, no, "reason", "n"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 <> 0 THEN 'brand=' || p_brand END, 'size=' || p_size, 'type=' || p_type], lambda x: x IS NOT NULL), ', ') AS extras FROM part")
def extras_projection(spark, sf):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"), F.lit("__id"), F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", rules.extras(values, ["name", "chapter", "story_order", "evidence_chunk", "embedding"]).alias("extras"))


@query("SELECT event_id, CAST(floor(value) AS INT) % 11 AS score FROM events WHERE CAST(floor(value) AS INT) % 11 >= 7")
def findings_threshold(spark, sf):
    s = F.floor("value").cast("int") % 11
    return t(spark, sf, "events").where(s >= rules.TAU).select("event_id", s.alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(10, greatest(0, CAST(event_id % 17 - 3 AS INT))) END AS score, CASE WHEN event_id % 9 = 0 THEN 'score_not_int' WHEN event_id % 17 - 3 NOT BETWEEN 0 AND 10 THEN 'score_out_of_range' ELSE '' END AS flags FROM events")
def verdict_clamp(spark, sf):
    score, flags = rules.clamp_score(F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((F.col("event_id") % 17 - 3).cast("string")))
    return t(spark, sf, "events").select("event_id", score.alias("score"), F.array_join(flags, ",").alias("flags"))


def _lines(spark, sf):
    o = t(spark, sf, "orders")
    picked = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % 5).cast("int")))
    return o.select("o_orderkey", picked.alias("picked"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("candidates"))


PICKED_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN []::INT[] ELSE [CAST(o_orderkey % 7 AS INT), CAST(o_orderkey % 5 AS INT)] END AS p FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN f THEN '1,2,3,4' ELSE array_to_string(p, ',') END AS lines, f AS fell_back FROM (SELECT o_orderkey, p, len(p) = 0 OR NOT list_has_all([1, 2, 3, 4], p) AS f FROM ({PICKED_SQL}))")
def line_fallback(spark, sf):
    lines, fell = rules.picked_lines(F.col("picked"), F.col("candidates"))
    return _lines(spark, sf).select("o_orderkey", F.array_join(lines.cast("array<string>"), ",").alias("lines"), fell.alias("fell_back"))


@query(f"SELECT o_orderkey, array_to_string(list_filter(p, lambda x: x BETWEEN 1 AND 5), ',') AS lines FROM ({PICKED_SQL})")
def line_bounds(spark, sf):
    return _lines(spark, sf).select("o_orderkey", F.array_join(rules.in_bounds(F.col("picked"), F.lit(5)).cast("array<string>"), ",").alias("lines"))


@query("SELECT p_name, count(DISTINCT p_type) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def unmerged_descriptions(spark, sf):
    merged = t(spark, sf, "part").groupBy("p_name").agg(F.collect_set("p_type").alias("description"))
    return merged.where(F.size("description") > 1).select("p_name", F.size("description").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backlog(spark, sf):
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return t(spark, sf, "documents").where("text <> ''").join(v, "doc_id", "left_anti").select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_type ELSE p_name || ': ' || p_type END AS text FROM part")
def fact_text(spark, sf):
    name, desc = F.when(F.col("p_size") % 4 == 1, None).otherwise(F.col("p_name")), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type"))
    return t(spark, sf, "part").select("p_partkey", rules.fact_text(name, desc).alias("text"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'short' END AS reason FROM documents WHERE length(trim(coalesce(text, ''))) < 20")
def invalid_chapters(spark, sf):
    body = F.trim(F.coalesce("text", F.lit("")))
    return t(spark, sf, "documents").where(F.length(body) < 20).select("doc_id", F.when(body == "", "empty").otherwise("short").alias("reason"))


# ---- joins


@query(f"WITH {FACTS_SQL}, {EVIDENCE_SQL} SELECT DISTINCT f.node_id AS fact_id, e.chunk_id FROM facts f JOIN evidence e ON e.node_id = f.node_id AND e.idx IN (f.node_id % 3 + 1, f.node_id % 5 + 1)")
def link_evidence(spark, sf):
    f = facts(spark, sf).select("node_id", F.col("node_id").alias("fact_id"), F.concat(F.lit("C"), F.col("node_id") % 3 + 1, F.lit(", C"), F.col("node_id") % 5 + 1).alias("evidence"))
    return J.link_evidence(f, evidence(spark, sf).select("node_id", "idx", "chunk_id"), ["node_id"])


@query(f"WITH {FACTS_SQL}, {EVIDENCE_SQL} SELECT e.chunk_id, coalesce(CASE WHEN e.idx = 1 THEN NULL ELSE e.chapter END, f.chapter) AS chapter FROM evidence e LEFT JOIN facts f USING (node_id)")
def chunk_chapter(spark, sf):
    e = evidence(spark, sf).select("node_id", "chunk_id", F.when(F.col("idx") != 1, F.col("chapter")).alias("own"))
    return e.join(facts(spark, sf).select("node_id", "chapter"), "node_id", "left").select("chunk_id", F.coalesce("own", "chapter").alias("chapter"))


CONTEXT_SQL = f"""{FACTS_SQL}, {EVIDENCE_SQL}, est AS (SELECT node_id, min(chapter + 1) AS c FROM evidence WHERE l_partkey % 2 = 0 GROUP BY node_id), cit AS (SELECT node_id, min(chapter) AS c, count(*) AS n FROM evidence GROUP BY node_id),
ctx AS (SELECT f.*, coalesce(f.chapter, est.c, cit.c) AS est_chapter, coalesce(cit.n, 0) AS n_evidence FROM facts f LEFT JOIN est USING (node_id) LEFT JOIN cit USING (node_id))"""


def context_rows(spark, sf):
    e = evidence(spark, sf)
    return J.fact_context(facts(spark, sf), e.where("l_partkey % 2 = 0").select("node_id", (F.col("chapter") + 1).alias("chapter")), e)


@query(f"WITH {CONTEXT_SQL} SELECT node_id, est_chapter, n_evidence FROM ctx")
def fact_context(spark, sf):
    return context_rows(spark, sf).select("node_id", "est_chapter", "n_evidence")


@query("SELECT o_orderpriority AS fact, array_to_string(list_sort(list_distinct(list(c_mktsegment || c_nationkey))), ',') AS participants FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority")
def fact_participants(spark, sf):
    edges = t(spark, sf, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_orderstatus") == "F", "HAS_STATE").when(F.col("o_orderstatus") == "O", "APPEARS_IN").otherwise("KNOWS").alias("type"))
    named = edges.where(F.col("type").isin("APPEARS_IN", "HAS_STATE")).join(t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat("c_mktsegment", "c_nationkey").alias("name")), "o_custkey")
    return J.names_of(named, "o_orderpriority", "name", "participants").select(F.col("o_orderpriority").alias("fact"), F.array_join("participants", ",").alias("participants"))


RELATED_SQL = f"""WITH {FACTS_SQL}, {EVIDENCE_SQL} SELECT node_id, array_to_string(list_sort(list_distinct(list(r))), ',') AS related FROM (SELECT f.node_id, CASE WHEN f.label = 'Event' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS r FROM facts f JOIN evidence e USING (node_id)) GROUP BY node_id"""


@query(RELATED_SQL)
def fact_related(spark, sf):
    f, e = facts(spark, sf).select("node_id", "label"), evidence(spark, sf)
    hosts = f.where("label = 'Event'").join(e, "node_id").select("node_id", F.concat(F.lit("S"), "l_suppkey").alias("name"))
    about = f.where("label = 'CharacterState'").join(e, "node_id").select("node_id", F.concat(F.lit("P"), "l_partkey").alias("name"))
    return J.names_of(hosts.unionByName(about), "node_id", "name", "related").select("node_id", F.array_join("related", ",").alias("related"))


@query("""WITH s AS (SELECT o_custkey AS c, o_orderkey AS s, o_orderstatus || o_orderkey AS state, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(year(o_orderdate) - 1991 AS INT) END AS chapter FROM orders),
g AS (SELECT DISTINCT l_orderkey AS s, 'P' || l_partkey AS target FROM lineitem WHERE l_linenumber = 1),
j AS (SELECT c_name || '' AS name, c_mktsegment AS aliases, state, target, chapter FROM customer LEFT JOIN s ON s.c = c_custkey LEFT JOIN g ON g.s = s.s)
SELECT name, aliases, array_to_string(list_sort(list_distinct(list(state || '>' || coalesce(target, '')) FILTER (state IS NOT NULL))), ';') AS states FROM (SELECT name, aliases, state, coalesce(target, '') AS target, chapter FROM j) WHERE chapter IS NULL OR chapter < 3 GROUP BY name, aliases""")
def prior_state_roster(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("char_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("aliases"))
    k = F.col("o_orderkey")
    s = t(spark, sf, "orders").select(F.col("o_custkey").alias("char_id"), k.alias("state_id"), F.concat("o_orderstatus", k).alias("state"), F.when(k % 4 == 0, None).otherwise(F.year("o_orderdate") - 1991).alias("chapter"))
    g = t(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("state_id"), F.concat(F.lit("P"), "l_partkey").alias("target")).distinct()
    s = s.join(g, "state_id", "left").select("char_id", "state_id", "state", "chapter", F.coalesce("target", F.lit("")).alias("target"))
    out = J.roster(c, s.drop("target"), s.select("state_id", "target"), 3)
    # A character without states has none at all, which is not an empty text.
    return out.select("name", "aliases", F.when(F.size("states") > 0, F.array_join("states", ";")).alias("states"))


@query("SELECT DISTINCT q.p_partkey AS query_id, e.p_partkey AS node_id FROM part q JOIN part e ON q.p_name = e.p_name OR list_contains(list_transform(string_split(e.p_type || ',' || e.p_brand, ','), lambda x: trim(x)), q.p_name) WHERE q.p_partkey % 100 = 0")
def entity_match(spark, sf):
    p = t(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), X.alias_flatten(F.array(F.concat_ws(",", "p_type", "p_brand"))).alias("aliases"))
    return J.entity_match(p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("asked")), e)


@query("""WITH own AS (SELECT DISTINCT conv_id, role || turn % 3 AS name FROM conversations WHERE turn % 2 = 0), other AS (SELECT DISTINCT conv_id, role || turn % 3 AS name FROM conversations WHERE turn % 2 = 1)
SELECT conv_id, name, 'own' AS side FROM own UNION ALL SELECT conv_id, name, 'other' FROM other o WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.conv_id = o.conv_id AND own.name = o.name)""")
def related_characters(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn") % 3).alias("name"))
    own = c.where("turn % 2 = 0").select("conv_id", "name", F.lit("own").alias("side")).distinct()
    other = c.where("turn % 2 = 1").select("conv_id", "name", F.lit("other").alias("side")).distinct()
    return J.related_by_name(own, other, "conv_id")


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 100000000 AS b FROM lineitem) SELECT a AS node_id, b AS other FROM e UNION ALL SELECT b, a FROM e")
def entity_facts(spark, sf):
    return J.adjacency(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000000).alias("dst")))


@query(f"WITH {FACTS_SQL}, {EVIDENCE_SQL} SELECT e.chunk_id, f.node_id, f.label FROM evidence e JOIN facts f USING (node_id) WHERE e.idx <= 2")
def chunk_facts(spark, sf):
    return evidence(spark, sf).where("idx <= 2").join(facts(spark, sf), "node_id").select("chunk_id", "node_id", "label")


@query(f"""WITH {LINES_SQL}, b AS (SELECT item_id, {loose_sql('text')} AS g FROM benchmark), d AS (SELECT doc_id, {loose_sql('text')} AS body FROM documents), n AS (SELECT doc_id, line_no, {loose_sql('line')} AS q FROM lines),
cm AS (SELECT doc_id, line_no, q, coalesce(q || lead(q) OVER (PARTITION BY doc_id ORDER BY line_no), q) AS fields FROM n), h AS MATERIALIZED (SELECT item_id, g, doc_id, strpos(body, g) AS gi, body FROM b, d WHERE g <> '')
SELECT * FROM (SELECT item_id AS truth_id, doc_id, line_no, CASE WHEN q <> '' AND (contains(q, g) OR contains(g, q)) THEN 'quote' WHEN gi > 0 AND q <> '' AND strpos(body, q) > 0 AND greatest(gi, strpos(body, q)) < least(gi + length(g), strpos(body, q) + length(q)) THEN 'span'
WHEN length(g) >= 5 AND gi > 0 AND contains(fields, g) THEN 'field' END AS kind FROM h JOIN cm USING (doc_id)) WHERE kind IS NOT NULL""")
def gt_match(spark, sf):
    """Every benchmark passage with every line of every document as a claim; a claim's fields are its line and the next one."""
    truth = t(spark, sf, "benchmark").select(F.col("item_id").alias("truth_id"), X.loose(F.col("text")).alias("g"))
    q = F.transform(X.line_parts(F.col("text")), lambda x: X.loose(x))
    both = F.zip_with("qs", F.slice("qs", 2, F.size("qs")), lambda a, b: F.struct(a.alias("q"), F.concat(a, F.coalesce(b, F.lit(""))).alias("fields")))
    claims = t(spark, sf, "documents").select("doc_id", q.alias("qs")).select("doc_id", F.posexplode(both).alias("pos", "c"))
    claims = claims.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "c.q", "c.fields")
    return J.match_quotes(truth, claims, t(spark, sf, "documents").select("doc_id", X.loose(F.col("text")).alias("body")))


@query(f"""WITH {EVIDENCE_SQL}, a AS (SELECT 'C' || chunk_id AS alias, chunk_id, chapter, idx FROM evidence UNION ALL SELECT 'F' || node_id, chunk_id, chapter, idx FROM evidence),
n AS (SELECT claim_id, alias, pos FROM (SELECT o_orderkey AS claim_id, unnest(['C' || (o_orderkey * 8 + 2), 'X1', 'F' || o_orderkey]) AS alias, unnest([0, 1, 2]) AS pos FROM orders)),
j AS (SELECT claim_id, chapter, idx, min(pos * 1000000000000 + chunk_id) AS f FROM n JOIN a USING (alias) GROUP BY claim_id, chapter, idx)
SELECT claim_id, f % 1000000000000 AS chunk_id, row_number() OVER (PARTITION BY claim_id ORDER BY f // 1000000000000, chapter, idx) AS rank FROM j""")
def resolve_cited(spark, sf):
    e = evidence(spark, sf)
    aliases = e.select(F.concat(F.lit("C"), "chunk_id").alias("alias"), "chunk_id", "chapter", "idx").union(e.select(F.concat(F.lit("F"), "node_id"), "chunk_id", "chapter", "idx"))
    cited = t(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.array(F.concat(F.lit("C"), F.col("o_orderkey") * 8 + 2), F.lit("X1"), F.concat(F.lit("F"), "o_orderkey")).alias("cited"))
    return J.resolve_cited(cited, aliases)


@query("SELECT c.conv_id AS job_id, f.n AS line_no, c.text FROM conversations c JOIN (SELECT conv_id, unnest([0, 1, 99]) AS n FROM (SELECT DISTINCT conv_id FROM conversations)) f ON f.conv_id = c.conv_id AND f.n = c.turn")
def finding_lines(spark, sf):
    c = t(spark, sf, "conversations")
    f = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(99))).alias("turn"))
    return f.join(c, ["conv_id", "turn"]).select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line_no"), "text")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def chapters_pending(spark, sf):
    done, todo = J.pending(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")
    return done.withColumn("done", F.lit(True)).union(todo.withColumn("done", F.lit(False)))


def held_passages(spark, sf):
    """(doc_id, marker_id): the benchmark passages that each document holds, both in loose form."""
    m = t(spark, sf, "benchmark").select(F.col("item_id").alias("marker_id"), X.loose(F.col("text")).alias("m"))
    return J.holding(t(spark, sf, "documents").select("doc_id", X.loose(F.col("text")).alias("body")), m).drop("place")


@query(f"""WITH d AS (SELECT doc_id, doc_id // 3 AS fact_id, {loose_sql('text')} AS body FROM documents), m AS (SELECT {loose_sql('text')} AS m FROM benchmark), j AS (SELECT fact_id, string_agg(body, '' ORDER BY doc_id) AS body FROM d GROUP BY 1)
SELECT 'chunk' AS kind, doc_id AS node_id FROM d WHERE EXISTS (SELECT 1 FROM m WHERE m <> '' AND contains(body, m)) UNION ALL SELECT 'fact', fact_id FROM j WHERE EXISTS (SELECT 1 FROM m WHERE m <> '' AND contains(body, m))""")
def marker_bearing(spark, sf):
    """Documents that hold a marker, whole, and facts whose evidence, three documents one after the other, does."""
    m = t(spark, sf, "benchmark").select(F.col("item_id").alias("marker_id"), X.loose(F.col("text")).alias("m"))
    d = t(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), X.loose(F.col("text")).alias("body"))
    return J.marker_bearing(chunks, d.select(F.floor(F.col("doc_id") / 3).alias("fact_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos")), m)


@query(f"WITH {EVIDENCE_SQL} SELECT DISTINCT claim_id, chunk_id FROM (SELECT l_partkey AS claim_id, chunk_id FROM evidence WHERE idx = 1 UNION ALL SELECT c.l_partkey, e.chunk_id FROM evidence c JOIN evidence e ON c.node_id = e.node_id WHERE c.idx = 2)")
def cited_closure(spark, sf):
    e = evidence(spark, sf)
    cited = e.where("idx = 1").select(F.col("l_partkey").alias("claim_id"), F.lit("chunk").alias("kind"), F.col("chunk_id").alias("node_id")).union(e.where("idx = 2").select("l_partkey", F.lit("fact"), "node_id"))
    return J.cited_closure(cited, e.select("node_id", "chunk_id"))


@query("SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def negatives_only(spark, sf):
    lab = t(spark, sf, "labels")
    return J.pending(lab.where("toxic = 1").select("doc_id").distinct(), lab.where("quality = 1"), "doc_id")[1]
