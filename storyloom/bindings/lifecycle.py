"""Sinks and streams over the driver's tables; each stream's SQL is its batch twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.bindings.text import CHUNKS_SQL, chunk_rows
from storyloom.catalog import query, t
from storyloom.functions.schema import FACTS
from storyloom.operators.indexing import Graph
from storyloom.sources import tables as T
from storyloom.sources.tables import kept
from storyloom.streaming import jobs as K


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT 'chunk-' || source || '-' || doc_id || '-' || (chunk - 1) AS chunk_id FROM chunks JOIN documents USING (doc_id)")
def sink_chunks(spark, sf):
    """Chunks under deterministic ids, by work and chapter: all of them, then those of every third chapter once more. The others stay."""
    c = kept(chunk_rows(spark, sf).select("source", "doc_id", F.concat_ws("-", F.lit("chunk"), "source", "doc_id", "chunk_index").alias("chunk_id")), "chunks")
    path = K.place(spark, "chunks")
    T.put_keys(c, path, ["source", "doc_id"], ["source"], 4)
    return T.put_keys(c.where("doc_id % 3 = 0"), path, ["source", "doc_id"], ["source"], 4).select("chunk_id")


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id AS number, source, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS version, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)")
def sink_chapters(spark, sf):
    """Chapters written, then some written again in a new version by work, and the links of their chunks."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("number"), "source")
    path = K.place(spark, "chapters")
    old = T.put_partitions(d.withColumn("version", F.lit("old")), f"{path}/1", "source")
    now = T.put_partitions(T.upsert(old, d.where("number % 2 = 0").withColumn("version", F.lit("new")), "number"), f"{path}/2", "source")
    c = chunk_rows(spark, sf).select("source", F.col("doc_id").alias("number"), F.concat_ws("-", F.lit("chunk"), "source", "doc_id", "chunk_index").alias("chunk_id"))
    links = T.put_partitions(c, f"{path}/links", "source").groupBy("number").agg(F.count("*").alias("n_chunks"))
    return now.join(links, "number", "left").select("number", "source", "version", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query("SELECT 'node' AS kind, 'n' || n_nationkey AS a, NULL AS b, CAST(n_regionkey AS VARCHAR) AS tenant_id FROM nation UNION ALL SELECT 'edge', 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_regionkey AS VARCHAR) FROM nation")
def sink_graph(spark, sf):
    """Nodes and relationships, each with its tenant in the same write."""
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("r"), F.col("n_regionkey").cast("string").alias("tenant"))
    path = K.place(spark, "graph")
    nodes = T.stamped(n.select("a", F.lit(None).cast("string").alias("b"), "tenant"), F.col("tenant"))
    edges = T.stamped(n.select("a", F.col("r").alias("b"), "tenant"), F.col("tenant"))
    out = [T.put_partitions(x.withColumn("tenant", F.col("tenant_id")), f"{path}/{kind}", "tenant").select(F.lit(kind).alias("kind"), "a", "b", "tenant_id") for kind, x in (("node", nodes), ("edge", edges))]
    return out[0].union(out[1])


@query("SELECT 'story' AS level, source, max(doc_id) AS chapter, arg_max(text, doc_id) AS summary FROM documents GROUP BY source UNION ALL SELECT 'chapter', source, doc_id, text FROM documents")
def sink_summaries(spark, sf):
    """Summaries of all chapters, some of them written again, and the last one of each story; its marker row is written after both."""
    c, path = t(spark, sf, "documents").select("source", F.col("doc_id").alias("chapter"), F.col("text").alias("summary")), K.place(spark, "summaries")
    T.put_keys(c, f"{path}/chapters", ["source", "chapter"], ["source"], 4)
    chapters = T.put_keys(c.where("chapter % 4 = 0"), f"{path}/chapters", ["source", "chapter"], ["source"], 4)
    stories = T.put_keys(chapters.groupBy("source").agg(F.max("chapter").alias("chapter"), F.max_by("summary", "chapter").alias("summary")), f"{path}/stories", ["source"])
    T.put_keys(stories.select("source"), f"{path}/markers", ["source"])
    done = spark.read.parquet(f"{path}/markers").select("source")
    level = lambda rows, name: rows.join(done, "source", "left_semi").select(F.lit(name).alias("level"), "source", "chapter", "summary")
    return level(stories, "story").union(level(chapters, "chapter"))


@query("SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id FROM events WHERE event_id % 11 >= 7")
def sink_findings(spark, sf):
    """Findings of all jobs, then those of every fifth job once more: a job's rows are replaced, the others stay."""
    f = t(spark, sf, "events").where("event_id % 11 >= 7").select(F.col("user_id").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), "event_id")
    path = K.place(spark, "findings")
    T.put_keys(f, path, ["job_id"])
    return T.put_keys(f.where("job_id % 5 = 0"), path, ["job_id"]).select("job_id", "seq", "event_id")


@query("SELECT '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY event_type")
def report_table(spark, sf):
    """A report of few rows written as JSON and as lines of Markdown; the lines are read back."""
    rows = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return T.put_report(rows, K.place(spark, "report"), "event_type", "n")


@query("SELECT doc_id, source FROM documents")
def stream_index(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").repartition(4)
    return K.ingest(K.source(d.union(d.where("doc_id % 3 = 0")), "bundles"), ["doc_id"])


#: Files that a log of events arrives in, and how far its rows come out of order; jobs wait as long.
FILES, DISORDER = 3, "1 day"


def arrived(spark, sf, rows, late, job):
    """Results of a job over the log, file by file, its state carried from one to the next."""
    return job.tick(K.followed(spark, rows.schema, K.in_order(rows, "ts", "log", FILES, late), 1))


@query("SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedupe(spark, sf):
    """Each job and kind once a day, over files that overlap by a day; a day's keys leave the state when no row of that day can come any more."""
    e = t(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    job = K.Job(spark, K.place(spark, "dedupe"), "ts", DISORDER, lambda rows: K.dedupe(rows, ["user_id", "event_type", "day"], "ts", DISORDER))
    return arrived(spark, sf, e, DISORDER, job).select("user_id", "event_type", "day")


@query("SELECT conv_id, turn, turn < coalesce(min(CASE WHEN turn <> r - 1 THEN turn END) OVER (PARTITION BY conv_id), 1e9) AS admitted FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 4 <> 2)")
def stream_continuity(spark, sf):
    c = t(spark, sf, "conversations").where("turn % 4 <> 2").select("conv_id", "turn")
    return K.ran(K.stateful(K.source(c, "turns"), "conv_id", K.Continuity(), "conv_id long, turn long, admitted boolean"))


def quota_calls(spark, sf):
    """Every event as a call on a model: errors, and one in 50, observe what is left and for how long; the others spend."""
    e = F.col("event_id")
    return t(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_type") == "error") | (e % 50 == 0)).alias("observed"), (e % 37).alias("tokens"), ((e % 7) * 3600000).alias("reset"))


def quota_job(spark, out):
    schema = "model string, at long, n long, restored boolean, left_over long"
    return K.Job(spark, out, "ts", DISORDER, lambda rows: K.stateful(rows.withWatermark("ts", DISORDER), "model", K.Quota(), schema, "eventTime"))


def balances(log):
    """What is left of each model after all its calls."""
    return log.groupBy("model").agg(F.max_by("left_over", F.struct("n", "restored")).alias("left_over"))


@query()
def stream_quota(spark, sf):
    """What is left of each model's quota after all calls and resets; brute force in tests, as SQL would step row by row."""
    return balances(arrived(spark, sf, quota_calls(spark, sf), DISORDER, quota_job(spark, K.place(spark, "quota"))))


def usage_rows(spark, sf):
    return t(spark, sf, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def usage_job(spark, window, keys):
    return K.Job(spark, K.place(spark, "usage"), "ts", DISORDER, lambda rows: K.windowed(rows, "ts", DISORDER, window, keys, "value"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def stream_usage(spark, sf):
    """Windows of a day over files that overlap by a day; those that a row may still come for are not shown."""
    out = arrived(spark, sf, usage_rows(spark, sf), DISORDER, usage_job(spark, F.window("ts", "1 day"), ["event_type"]))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT strftime(w, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def stream_usage_sliding(spark, sf):
    """Windows of a day that start every twelve hours."""
    out = arrived(spark, sf, usage_rows(spark, sf), DISORDER, usage_job(spark, F.window("ts", "1 day", "12 hours"), ["event_type"]))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_usage_session(spark, sf):
    """Sessions of a user, closed by two hours without a call."""
    out = arrived(spark, sf, usage_rows(spark, sf), DISORDER, usage_job(spark, F.session_window("ts", "2 hours"), ["user_id"]))
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def stream_status(spark, sf):
    """The last status of each job, in one table that each batch brings up to date where its jobs are; a batch that runs again changes nothing."""
    rows = t(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    log, out = K.in_order(rows, "ts", "status", FILES, DISORDER), K.place(spark, "statuses")

    def batch(df, number):
        T.put_latest(df, out, ["user_id"], ["ts", "event_id"], 8)

    K.followed(spark, rows.schema, log, 1).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", F.col("event_type").alias("status"))


def extracted(docs):
    """(tenant, chapter, raw): as a model would answer, two names of each text as characters at a place, and an event there; one node, one property and one edge are not allowed."""
    names = F.slice(F.array_distinct(F.coalesce(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)), F.array().cast("array<string>"))), 1, 2)
    node = lambda i, label, *props: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.create_map(*props).cast("map<string,string>").alias("properties"))
    place = F.concat(F.when(F.col("chapter") % 2 == 0, "<Loc ").otherwise("Loc"), (F.col("chapter") % 7).cast("string"), F.when(F.col("chapter") % 2 == 0, ">").otherwise(""))
    people = F.transform(names, lambda n, i: F.struct(F.concat(F.lit("c"), i).alias("id"), F.lit("Character").alias("label"), F.create_map(F.lit("name"), n).cast("map<string,string>").alias("properties")))
    others = F.array(node("l", "Location", F.lit("name"), place, F.lit("secret"), F.lit("x")), node("e", "Event", F.lit("name"), F.concat(F.lit("event "), "chapter"), F.lit("chapter"), F.col("chapter").cast("string"), F.lit("evidence_chunk"), F.lit("C0")), node("m", "Mood", F.lit("name"), F.lit("dark")))
    edge = lambda a, kind, b: F.struct(F.lit(kind).alias("type"), F.lit(a).alias("start_node_id"), F.lit(b).alias("end_node_id"))
    return docs.select("tenant", "chapter", F.to_json(F.struct(F.concat(people, others).alias("nodes"), F.array(edge("l", "HOSTS", "e"), edge("l", "APPEARS_IN", "e")).alias("relationships"))).alias("raw"))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, d AS (SELECT *, coalesce(source, '-') AS tenant FROM documents), n AS (SELECT doc_id, least(2, count(DISTINCT name)) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM documents) GROUP BY 1), p AS (SELECT doc_id, count(*) AS c, count(*) - 1 AS l FROM chunks GROUP BY 1)
SELECT tenant, count(*) AS chapters, CAST(sum(coalesce(c, 0)) AS BIGINT) AS chunks, CAST(sum(coalesce(l, 0)) AS BIGINT) AS links, CAST(sum(coalesce(k, 0)) AS BIGINT) AS mentions, count(DISTINCT doc_id % 7) AS places, count(*) AS facts, count(*) AS hosts, count(c) AS evidence, 3 * count(*) AS pruned, max(doc_id) AS last_chapter, arg_max(md5(coalesce(text, '')), doc_id) AS summary FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY tenant""")
def index_chapters(spark, sf):
    """Three bundles of chapters, each with some that an earlier one had: chunks and their order, nodes and edges of the allowed kinds, evidence, names resolved where the bundle touches them, summaries, markers last."""
    d = t(spark, sf, "documents").select(F.coalesce("source", F.lit("-")).alias("tenant"), F.col("doc_id").cast("int").alias("chapter"), F.coalesce("text", F.lit("")).alias("text"))
    g = Graph(spark, K.place(spark, "graph"))
    for bundle in (d.where("chapter % 2 = 0"), d.where("chapter % 3 = 0"), d):
        g.add(bundle, extracted(bundle), bundle.select("tenant", "chapter", F.md5(F.col("text").cast("binary")).alias("summary")))
    count = lambda name, rows: rows.groupBy("tenant").agg(F.count("*").alias(name))
    nodes = g.read("nodes")
    out = count("chapters", g.read("markers"))
    for part in (
        count("chunks", g.read("chunks")), count("links", g.read("chunks").where("next IS NOT NULL")), count("mentions", nodes.where("label = 'Character'")), count("places", g.entities().where("label = 'Location'")),
        count("facts", nodes.where(F.col("label").isin(FACTS))), count("hosts", g.edges().where("type = 'HOSTS'")), count("evidence", g.read("evidence")), g.read("pruned").groupBy("tenant").agg(F.sum("n").alias("pruned")),
    ):
        out = out.join(part, "tenant", "left")
    out = out.join(g.stories().select("tenant", F.col("chapter").cast("long").alias("last_chapter"), "summary"), "tenant")
    return out.select("tenant", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chapters", "chunks", "links", "mentions", "places", "facts", "hosts", "evidence", "pruned")], "last_chapter", "summary")
