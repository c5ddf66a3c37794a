"""Aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.bindings.base import EVIDENCE_SQL, evidence
from storyloom.bindings.rows import CONTEXT_SQL, context_rows, held_passages
from storyloom.bindings.text import LINES_SQL, NOISE_SQL, line_rows, loose_sql, norm_sql
from storyloom.catalog import query, t
from storyloom.functions import text as X
from storyloom.operators import aggregates as A
from storyloom.operators.joins import cited_closure



@query("SELECT event_type AS label, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type")
def label_counts(spark, sf):
    labels = t(spark, sf, "events").select(F.explode(F.array("event_type", F.lit("__Entity__"))).alias("label"))
    return labels.where(~F.col("label").isin("__Entity__", "view")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag || l_linestatus AS type, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'P' AND p_size < 40 GROUP BY 1")
def rel_counts(spark, sf):
    e = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("type"))
    o = t(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    p = t(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return e.join(o, "l_orderkey", "left_semi").join(p, "l_partkey", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {CONTEXT_SQL} SELECT est_chapter, label, count(*) AS n FROM ctx GROUP BY ALL")
def established_chapter(spark, sf):
    return context_rows(spark, sf).groupBy("est_chapter", "label").agg(F.count("*").alias("n"))


@query("SELECT source, max(doc_id) AS latest, array_to_string(list_sort(list(doc_id) FILTER (doc_id IN (1, 7, 20, 100, 300))), ',') AS have FROM documents GROUP BY source")
def index_progress(spark, sf):
    want = F.array(*map(F.lit, (1, 7, 20, 100, 300)))
    have = F.array_sort(F.array_intersect(F.collect_set(F.when(F.col("doc_id").isin(1, 7, 20, 100, 300), F.col("doc_id"))), want.cast("array<long>")))
    return t(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("latest"), F.nullif(F.array_join(have.cast("array<string>"), ","), F.lit("")).alias("have"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn))), ',') AS turns FROM conversations WHERE turn % 4 <> 2 GROUP BY conv_id")
def indexed_chapters(spark, sf):
    return t(spark, sf, "conversations").where("turn % 4 <> 2").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("turn")).cast("array<string>"), ",").alias("turns"))


@query("SELECT conv_id, gap FROM (SELECT conv_id, unnest(range(min(turn), max(turn) + 1)) AS gap FROM conversations WHERE turn % 4 <> 2 GROUP BY conv_id) g WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = g.conv_id AND c.turn = g.gap AND c.turn % 4 <> 2)")
def indexed_gaps(spark, sf):
    have = t(spark, sf, "conversations").where("turn % 4 <> 2").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.collect_set("turn").alias("s"))
    return have.select("conv_id", F.explode(F.array_except(F.sequence("a", "b"), F.col("s"))).alias("gap"))


@query("SELECT p_type AS label, p_name AS name, min(p_partkey) AS canonical, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def resolve_exact(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("name"), "p_partkey")
    return A.merge_nodes(p, ["label", "name"], [], [], "p_partkey").where("n > 1").select("label", "name", "canonical", "n")


NOISY = "CASE p_partkey % 3 WHEN 0 THEN '<' || p_name || '>' WHEN 1 THEN replace(p_name, ' ', '') ELSE p_name END"


@query(f"SELECT key, min(p_partkey) AS canonical, count(*) AS n FROM (SELECT regexp_replace({NOISY}, '{NOISE_SQL}', '', 'g') AS key, p_partkey FROM part) WHERE key <> '' GROUP BY key")
def resolve_normalized(spark, sf):
    noisy = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<"), "p_name", F.lit(">"))).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", " ", "")).otherwise(F.col("p_name"))
    p = t(spark, sf, "part").select(X.name_key(noisy).alias("key"), "p_partkey").where("key IS NOT NULL")
    return A.merge_nodes(p, ["key"], [], [], "p_partkey")


@query("SELECT p_name, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS description, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def merge_properties(spark, sf):
    m = A.merge_nodes(t(spark, sf, "part"), ["p_name"], ["p_type"], ["p_brand"], "p_partkey")
    return m.select("p_name", F.array_join("p_type", "|").alias("description"), F.col("p_brand").alias("brand"))


@query("SELECT p_type AS label, count(*) AS nodes_in, count(DISTINCT p_name) AS nodes_out FROM part GROUP BY p_type")
def resolve_stats(spark, sf):
    return t(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("nodes_in"), F.count_distinct("p_name").alias("nodes_out"))


USAGE_SQL = "usage AS (SELECT user_id % 10 AS run, event_type AS draft, 1 AS calls, event_id % 900 + 100 AS prompt, event_id % 100 AS cached, event_id % 300 AS completion, event_id % 50 AS reasoning FROM events)"


def usage(spark, sf):
    e = F.col("event_id")
    return t(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("draft"), F.lit(1).alias("calls"), (e % 900 + 100).alias("prompt"), (e % 100).alias("cached"), (e % 300).alias("completion"), (e % 50).alias("reasoning"))


@query(f"WITH {USAGE_SQL} SELECT run, draft, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(reasoning) AS BIGINT) AS reasoning FROM usage GROUP BY ROLLUP (run, draft)")
def usage_rollup(spark, sf):
    return A.usage_rollup(usage(spark, sf), ["run", "draft"], ["calls", "prompt", "cached", "completion", "reasoning"])


@query("SELECT l_orderkey, l_linenumber, round(((p - c) * 0.20 + c * 0.02 + o * 1.20) / 1e6, 9) AS cost, round((p * 0.20 + o * 1.20) / 1e6, 9) AS cold_cost FROM (SELECT l_orderkey, l_linenumber, l_partkey * 10.0 AS p, l_suppkey * 1.0 AS c, l_quantity * 100 AS o FROM lineitem)")
def usage_cost(spark, sf):
    p, c, o = F.col("l_partkey") * 10.0, F.col("l_suppkey") * 1.0, F.col("l_quantity") * 100
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *A.cost_columns(p, c, o))


@query(f"WITH {EVIDENCE_SQL} SELECT chunk_id, min(chapter) AS chapter, any_value(idx) AS idx FROM evidence GROUP BY chunk_id")
def docstore_chunks(spark, sf):
    e = evidence(spark, sf).select("chunk_id", "chapter", "idx")
    return e.union(e.where("idx = 1")).groupBy("chunk_id").agg(F.min(F.struct("chapter", "idx")).alias("s")).select("chunk_id", "s.chapter", "s.idx")


@query("""WITH h AS (SELECT l_partkey AS node_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS pos, l_returnflag || l_suppkey AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus || l_suppkey ELSE '' END AS description, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS story_order, l_suppkey AS chunk_id, CASE WHEN l_linenumber % 4 <> 0 THEN 'S' || l_suppkey % 20 END AS related FROM lineitem),
o AS (SELECT node_id, chunk_id, min(pos) AS p FROM h GROUP BY ALL), e AS (SELECT node_id, string_agg(chunk_id, ',' ORDER BY p) AS evidence FROM o GROUP BY node_id),
ro AS (SELECT node_id, related, min(pos) AS p FROM h WHERE related IS NOT NULL GROUP BY ALL), re AS (SELECT node_id, string_agg(related, ',' ORDER BY p) AS related FROM ro GROUP BY node_id)
SELECT node_id, arg_min(name, pos) AS name, arg_min(description, pos) FILTER (description <> '') AS description, arg_min(story_order, pos) FILTER (story_order IS NOT NULL) AS story_order, any_value(evidence) AS evidence, any_value(re.related) AS related FROM h JOIN e USING (node_id) LEFT JOIN re USING (node_id) GROUP BY node_id""")
def docstore_facts(spark, sf):
    n = F.col("l_linenumber")
    h = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("node_id"), ((F.col("l_orderkey") * 8 + n) * 1000000 + F.col("l_suppkey")).alias("pos"), F.concat("l_returnflag", "l_suppkey").alias("name"), F.when(n % 2 == 0, F.concat("l_linestatus", "l_suppkey")).otherwise("").alias("description"), F.when(n % 3 == 0, F.col("l_discount")).alias("story_order"), F.col("l_suppkey").alias("chunk_id"), F.when(n % 4 != 0, F.concat(F.lit("S"), F.col("l_suppkey") % 20)).alias("related"))
    return A.docstore_facts(h).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ",")).withColumn("related", F.array_join("related", ","))


@query("SELECT DISTINCT c_custkey AS node_id, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey")
def docstore_entities(spark, sf):
    hits = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).join(t(spark, sf, "customer"), "c_custkey")
    return hits.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name")).dropDuplicates(["node_id"])


@query(f"WITH {EVIDENCE_SQL} SELECT l_partkey AS claim_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT node_id) FILTER (idx > 1) AS facts FROM evidence GROUP BY 1")
def claim_refs(spark, sf):
    refs = evidence(spark, sf).groupBy(F.col("l_partkey").alias("claim_id")).agg(F.collect_set("chunk_id").alias("c"), F.collect_set(F.when(F.col("idx") > 1, F.col("node_id"))).alias("f"))
    return refs.select("claim_id", F.size("c").cast("long").alias("chunks"), F.size("f").cast("long").alias("facts"))


@query(f"WITH {EVIDENCE_SQL} SELECT claim_id, md5(string_agg(x, chr(10) ORDER BY x)) AS pool_md5 FROM (SELECT DISTINCT claim_id, l_comment || '' AS x FROM (SELECT c.l_partkey AS claim_id, e.l_partkey || ':' || e.chunk_id AS l_comment FROM evidence c JOIN evidence e ON c.node_id = e.node_id WHERE c.idx = 1)) GROUP BY claim_id")
def claim_pool(spark, sf):
    e = evidence(spark, sf)
    cited = e.where("idx = 1").select(F.col("l_partkey").alias("claim_id"), F.lit("fact").alias("kind"), "node_id")
    texts = e.select("chunk_id", F.concat_ws(":", "l_partkey", "chunk_id").alias("x"))
    pool = cited_closure(cited, e.select("node_id", "chunk_id")).join(texts, "chunk_id").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("x")), "\n").alias("p"))
    return pool.select("claim_id", F.md5(F.col("p").cast("binary")).alias("pool_md5"))


REACH_SQL = f"""bl AS (SELECT item_id, {loose_sql('text')} AS m FROM benchmark), dl AS (SELECT doc_id, source, {loose_sql('text')} AS body, row_number() OVER (PARTITION BY md5({norm_sql('text')}) ORDER BY doc_id) = 1 AS first FROM documents),
hp AS MATERIALIZED (SELECT source, item_id, first FROM dl JOIN bl ON m <> '' AND contains(body, m)), r AS (SELECT s.source AS draft, b.item_id, EXISTS (SELECT 1 FROM hp WHERE hp.source = s.source AND hp.item_id = b.item_id) AS hit FROM (SELECT DISTINCT source FROM documents) s, benchmark b)"""


def reached(spark, sf):
    """(draft, item_id): passages that a document of the draft holds, whole."""
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("draft"))
    return d.join(held_passages(spark, sf), "doc_id").select("draft", F.col("marker_id").alias("item_id")).distinct()


def reach_counts(spark, sf, items):
    """(draft, truths, reached) for every draft."""
    n = items.agg(F.count("*").alias("truths"))
    hits = reached(spark, sf).join(items, "item_id", "left_semi").groupBy("draft").agg(F.count("*").alias("reached"))
    drafts = t(spark, sf, "documents").select(F.col("source").alias("draft")).distinct()
    return drafts.join(hits, "draft", "left").crossJoin(F.broadcast(n)).select("draft", "truths", F.coalesce("reached", F.lit(0)).alias("reached"))


@query(f"WITH {REACH_SQL} SELECT coalesce(draft, 'total') AS draft, count(*) AS truths, count(*) FILTER (hit) AS reached, round(count(*) FILTER (hit) / count(*), 6) AS share FROM r GROUP BY ROLLUP (draft)")
def coverage_reach(spark, sf):
    r = reach_counts(spark, sf, t(spark, sf, "benchmark").select("item_id")).rollup("draft").agg(F.sum("truths").alias("truths"), F.sum("reached").alias("reached"))
    return r.select(F.coalesce("draft", F.lit("total")).alias("draft"), "truths", "reached", F.round(F.col("reached") / F.col("truths"), 6).alias("share"))


SCORES_SQL = "s AS (SELECT event_id, user_id, event_id % 11 AS score, event_type IN ('purchase', 'click') AS truth FROM events)"


def scores(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 11).alias("score"), F.col("event_type").isin("purchase", "click").alias("truth"))


@query(f"WITH {SCORES_SQL} SELECT CAST(tau AS INT) AS tau, count(*) FILTER (truth AND score >= tau) AS tp, count(*) FILTER (truth AND event_id % 3 <> 0 AND score >= tau) AS grounded, count(*) FILTER (NOT truth AND event_id % 5 = 0 AND score >= tau) AS hard_negatives, count(*) FILTER (NOT truth AND event_id % 5 <> 0 AND score >= tau) AS noise, count(*) FILTER (score >= tau) AS alarms FROM s, range(11) r(tau) GROUP BY tau")
def threshold_curve(spark, sf):
    """Truths found, those with their evidence, hard negatives, the rest, and all alarms, at each threshold."""
    truth, hard = F.col("truth"), F.col("event_id") % 5 == 0
    return A.threshold_curve(scores(spark, sf), {"tp": truth, "grounded": truth & (F.col("event_id") % 3 != 0), "hard_negatives": ~truth & hard, "noise": ~truth & ~hard, "alarms": F.lit(True)})


@query(f"WITH {SCORES_SQL} SELECT user_id, max(score) AS best, max(score) - min(score) AS spread, array_to_string(list_sort(list(score)), ',') AS scores, arg_max(event_id, score * 10000000000 - event_id) AS best_claim FROM s GROUP BY user_id")
def gt_spread(spark, sf):
    s = scores(spark, sf)
    g = s.groupBy("user_id").agg(F.max("score").alias("best"), (F.max("score") - F.min("score")).alias("spread"), F.max(F.struct("score", -F.col("event_id"))).alias("m"))
    return g.join(A.listed(s, "user_id", "score", "scores"), "user_id").select("user_id", "best", "spread", "scores", (-F.col("m.col2")).alias("best_claim"))


@query(f"WITH {SCORES_SQL} SELECT user_id, list_sort(list(score))[count(*) // 2 + 1] AS vote FROM s GROUP BY user_id")
def verdict_vote(spark, sf):
    return scores(spark, sf).groupBy("user_id").agg(A.upper_median("score").cast("long").alias("vote"))


@query(f"WITH {EVIDENCE_SQL}, c AS (SELECT DISTINCT c.l_partkey AS claim_id, e.chunk_id FROM evidence c JOIN evidence e ON c.node_id = e.node_id WHERE c.idx = 1) SELECT p_partkey AS claim_id FROM part WHERE p_size % 11 >= 7 AND EXISTS (SELECT 1 FROM c WHERE claim_id = p_partkey AND chunk_id % 13 = 0)")
def grounded_detection(spark, sf):
    e = evidence(spark, sf)
    closure = cited_closure(e.where("idx = 1").select(F.col("l_partkey").alias("claim_id"), F.lit("fact").alias("kind"), "node_id"), e.select("node_id", "chunk_id"))
    return t(spark, sf, "part").where("p_size % 11 >= 7").select(F.col("p_partkey").alias("claim_id")).join(closure.where("chunk_id % 13 = 0"), "claim_id", "left_semi")


@query("SELECT o_orderstatus AS draft, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unknown, count(*) FILTER (o_orderkey % 11 >= 7 AND o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS bare, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1) AS off_reference FROM orders GROUP BY 1")
def citation_hygiene(spark, sf):
    """Citations that no source has, high scores without any, and citations of sources that the claim was not given."""
    key = F.col("o_orderkey")
    cited = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("C1")))
    cited = F.when(key % 4 == 0, F.array_append(cited, F.lit("X9"))).otherwise(cited)
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("draft"), (key % 11).alias("score"), cited.alias("cited"), F.array(F.lit("C1"), F.lit("C2")).alias("known"), F.when(key % 2 == 0, F.array(F.lit("C1"))).otherwise(F.array(F.lit("C2"))).alias("given"))
    return A.citation_hygiene(o, "draft", 7)


@query(f"WITH {LINES_SQL}, q AS (SELECT doc_id, n, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN n + 1 ELSE 1 + doc_id % n END AS k, doc_id % 2 = 0 AS good FROM (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id)) SELECT count(*) AS total, count(*) FILTER (k IS NULL) AS empty, count(*) FILTER (k > n) AS out_of_range, count(*) FILTER (k <= n) AS valid, count(*) FILTER (k <= n AND contains({loose_sql('l.line')}, {loose_sql('CASE WHEN q.good THEN substr(l.line, 2, 10) ELSE chr(1) END')})) AS accurate FROM q LEFT JOIN lines l ON l.doc_id = q.doc_id AND l.line_no = q.k")
def line_hygiene(spark, sf):
    lines = line_rows(spark, sf)
    c = lines.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    d = F.col("doc_id")
    c = c.withColumn("k", F.when(d % 5 == 0, None).when(d % 7 == 0, F.col("n") + 1).otherwise(1 + d % F.col("n")))
    j = c.join(lines.withColumnRenamed("line_no", "k"), ["doc_id", "k"], "left")
    ok = F.col("k") <= F.col("n")
    accurate = X.loose(F.col("line")).contains(X.loose(F.when(d % 2 == 0, F.substring("line", 2, 10)).otherwise("\x01")))
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("k").isNull()).alias("empty"), F.count_if(F.col("k") > F.col("n")).alias("out_of_range"), F.count_if(ok).alias("valid"), F.count_if(ok & accurate).alias("accurate"))


@query("SELECT user_id, count(*) AS channels, count(*) FILTER (event_type = 'error') AS failed, bool_and(event_type = 'error') AS all_failed FROM events GROUP BY user_id")
def channel_failures(spark, sf):
    failed = F.col("event_type") == "error"
    return t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("channels"), F.count_if(failed).alias("failed"), F.every(failed).alias("all_failed"))


@query("WITH w AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), g AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT coalesce(w.user_id, g.user_id) AS user_id, count(*) FILTER (g.user_id IS NULL) AS missing, count(*) FILTER (w.user_id IS NULL) AS extra FROM w FULL JOIN g ON w.user_id = g.user_id AND w.event_type = g.event_type GROUP BY 1")
def verdict_audit(spark, sf):
    e = t(spark, sf, "events")
    return A.verdict_audit(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "user_id", "event_type")


@query("SELECT run, cov, reach, cost, row_number() OVER (ORDER BY cov DESC, reach DESC, cost, run) AS place FROM (SELECT user_id % 20 AS run, count(DISTINCT event_type) AS cov, count(*) FILTER (event_id % 11 >= 7) AS reach, count(*) AS cost FROM events GROUP BY 1)")
def run_compare(spark, sf):
    from pyspark.sql import Window

    r = t(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("run")).agg(F.count_distinct("event_type").alias("cov"), F.count_if(F.col("event_id") % 11 >= 7).alias("reach"), F.count("*").alias("cost"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cov"), F.desc("reach"), "cost", "run")).cast("long"))


@query("WITH d AS (SELECT source, lang, length(text) // 2 AS n, row_number() OVER (PARTITION BY source, lang, md5(text)) AS r FROM documents) SELECT source, coalesce(lang, '-') AS part, CAST(sum(n) AS BIGINT) AS channel_tokens, CAST(coalesce(sum(n) FILTER (r = 1), 0) AS BIGINT) AS store_tokens, round(coalesce(sum(n) FILTER (r = 1), 0) / nullif(sum(n), 0), 6) AS ratio FROM d GROUP BY ALL")
def context_savings(spark, sf):
    """Tokens of the hits of all channels against each text once, by work and part, and their ratio."""
    d = t(spark, sf, "documents").select("source", F.coalesce("lang", F.lit("-")).alias("part"), F.md5(F.col("text").cast("binary")).alias("m"), F.floor(F.length("text") / 2).alias("n"))
    once = d.groupBy("source", "part", "m").agg(F.sum("n").alias("all"), F.max("n").alias("one"))
    g = once.groupBy("source", "part").agg(F.sum("all").alias("channel_tokens"), F.sum("one").alias("store_tokens"))
    return g.withColumn("ratio", F.round(F.col("store_tokens") / F.nullif("channel_tokens", F.lit(0)), 6))


@query(f"WITH {REACH_SQL} SELECT DISTINCT source AS draft, item_id FROM hp h WHERE NOT EXISTS (SELECT 1 FROM hp k WHERE k.first AND k.source = h.source AND k.item_id = h.item_id)")
def reach_parity(spark, sf):
    """Passages that a draft's channel reaches but its store doesn't, as a text that several drafts have is stored under the first only."""
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("draft"), F.md5(X.norm(F.col("text")).cast("binary")).alias("k"))
    stored = d.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("stored"))
    hits = held_passages(spark, sf).join(d.select("doc_id", "draft"), "doc_id").join(stored, "doc_id", "left")
    flags = hits.groupBy("draft", F.col("marker_id").alias("item_id")).agg(F.lit(True).alias("channel"), F.coalesce(F.max("stored"), F.lit(False)).alias("store"))
    return flags.where(~F.col("channel").eqNullSafe(F.col("store"))).select("draft", "item_id")


@query("SELECT user_id, count(*) AS backlog FROM events WHERE event_type IN ('view', 'click') GROUP BY ROLLUP (user_id)")
def backlog_count(spark, sf):
    return t(spark, sf, "events").where(F.col("event_type").isin("view", "click")).rollup("user_id").agg(F.count("*").alias("backlog"))


@query("SELECT user_id, bool_and(event_type IN ('purchase', 'error', 'click')) AS finished, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def job_terminal(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.every(F.col("event_type").isin("purchase", "error", "click")).alias("finished"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT user_id, 'C' || count(*) FILTER (event_id % 3 = 0) || '/F' || count(*) FILTER (event_id % 3 = 1) || '/E' || count(*) FILTER (event_id % 3 = 2) AS fingerprint FROM events GROUP BY user_id")
def store_fingerprint(spark, sf):
    kinds = t(spark, sf, "events").select("user_id", F.element_at(F.array(F.lit("C"), F.lit("F"), F.lit("E")), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"))
    p = kinds.groupBy("user_id").pivot("kind", ["C", "F", "E"]).count().fillna(0)
    return p.select("user_id", F.format_string("C%d/F%d/E%d", "C", "F", "E").alias("fingerprint"))


@query(f"WITH {REACH_SQL} SELECT draft, count(*) AS negatives, count(*) FILTER (hit) AS matched FROM r WHERE item_id % 2 = 1 GROUP BY draft")
def negative_table(spark, sf):
    return reach_counts(spark, sf, t(spark, sf, "benchmark").where("item_id % 2 = 1").select("item_id")).withColumnsRenamed({"truths": "negatives", "reached": "matched"})


@query("SELECT conv_id, coalesce(string_agg('[' || r || '] ' || x, chr(10) ORDER BY r) FILTER (x IS NOT NULL), '(nothing new)') AS content FROM (SELECT conv_id, text AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant' UNION ALL SELECT DISTINCT conv_id, NULL, NULL FROM conversations) GROUP BY conv_id")
def channel_content(spark, sf):
    """Numbered results of each conversation; those without any get a placeholder."""
    c = t(spark, sf, "conversations")
    kept = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("text").alias("x"))))).alias("k"))
    lines = F.transform("k", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["x"]))
    return kept.select("conv_id", F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(nothing new)")).alias("content"))


