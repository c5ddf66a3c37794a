"""Text operators over documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.catalog import query, t
from storyloom.functions import ratios, rules
from storyloom.functions import text as X
from storyloom.operators import search as S
from storyloom.operators import verdicts as V
from storyloom.operators.indexing import parsed

PUNCT_SQL = X.PUNCTUATION.replace("'", "''")
NOISE_SQL = X.NAME_NOISE.replace("'", "''")


def norm_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{X.BLANK}', '', 'g')"


def loose_sql(c: str) -> str:
    return f"regexp_replace({norm_sql(c)}, '{PUNCT_SQL}', '', 'g')"


SENT_SQL = "regexp_extract_all(text, '" + X.SENTENCE + "')"


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')}) AS n FROM documents")
def norm(spark, sf):
    n = X.norm(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(n.cast("binary")).alias("norm_md5"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({loose_sql('text')}) AS loose_md5 FROM documents")
def loose(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(X.loose(F.col("text")).cast("binary")).alias("loose_md5"))


@query(f"SELECT p_partkey, nullif(regexp_replace('<' || p_name || '> (' || p_brand || ')', '{NOISE_SQL}', '', 'g'), '') AS name_key FROM part")
def name_key(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.name_key(F.concat(F.lit("<"), "p_name", F.lit("> ("), "p_brand", F.lit(")"))).alias("name_key"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(list_concat(string_split(p_name || ', ' || p_brand, ','), string_split(p_type, ',')), lambda x: trim(x)), lambda x: x <> ''), '|') AS aliases FROM part")
def alias_flatten(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.array_join(X.alias_flatten(F.array(F.concat_ws(", ", "p_name", "p_brand"), F.col("p_type"))), "|").alias("aliases"))


@query("""SELECT l_orderkey, l_linenumber, unnest(list_transform(list_filter(list_transform(string_split('C' || l_linenumber || ', C' || l_partkey || ',x' || l_suppkey || ',C', ','), lambda x: trim(x)), lambda x: regexp_full_match(x, 'C[0-9]+')), lambda x: substr(x, 2)::INT)) AS chunk_no FROM lineitem""")
def evidence_tokens(spark, sf):
    tokens = F.concat(F.lit("C"), "l_linenumber", F.lit(", C"), "l_partkey", F.lit(",x"), "l_suppkey", F.lit(",C"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(X.evidence_tokens(tokens)).alias("chunk_no"))


MARKED_SQL = "SELECT conv_id, '[chapter:' || conv_id || ']' || chr(10) || string_agg('[C' || turn || '] ' || coalesce(text, ''), ' ' ORDER BY turn) AS marked FROM conversations GROUP BY conv_id"


def marked(spark, sf):
    c = t(spark, sf, "conversations")
    line = F.concat(F.lit("[C"), "turn", F.lit("] "), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.concat(F.lit("[chapter:"), F.first("conv_id"), F.lit("]\n"), F.array_join(F.transform(lines, lambda x: x["line"]), " ")).alias("marked"))


@query(f"SELECT conv_id, md5(marked) AS marked_md5 FROM ({MARKED_SQL})")
def marked_text(spark, sf):
    return marked(spark, sf).select("conv_id", F.md5(F.col("marked").cast("binary")).alias("marked_md5"))


@query("SELECT conv_id, turn AS chunk_no, md5(trim(coalesce(text, ''))) AS text_md5 FROM conversations")
def parse_markers(spark, sf):
    """The round trip of marked_text: its markers and the texts between them."""
    body = F.regexp_replace("marked", r"^\[chapter:[0-9]+\]\n", "")
    parts = marked(spark, sf).select("conv_id", F.explode(F.array(F.arrays_zip(F.regexp_extract_all(body, F.lit(r"\[C([0-9]+)\] "), F.lit(1)).alias("no"), F.slice(F.split(body, r"\[C[0-9]+\] "), 2, 1 << 30).alias("body")))).alias("z"))
    return parts.select("conv_id", F.explode("z").alias("z")).select("conv_id", F.col("z.no").cast("long").alias("chunk_no"), F.md5(F.trim("z.body").cast("binary")).alias("text_md5"))


SPANS_SQL = f"""s AS (SELECT doc_id, unnest({SENT_SQL}) AS s, generate_subscripts({SENT_SQL}, 1) AS i FROM documents),
o AS (SELECT doc_id, i, s, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS body, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(s) - length(ltrim(s, ' ' || chr(9) || chr(10) || chr(13))) AS b FROM s),
spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, CAST(b AS INT) AS start, CAST(b + length(body) AS INT) AS stop FROM o WHERE body <> '')"""


@query(f"WITH {SPANS_SQL} SELECT doc_id, start, stop FROM spans")
def sentence_spans(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.explode(X.sentence_spans(X.sentences(F.col("text")))).alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("SELECT doc_id, unnest(range(0, n_chars, 400)) AS start, least(start + 400, n_chars) AS stop FROM documents WHERE n_chars > 0")
def split_oversized(spark, sf):
    d = t(spark, sf, "documents").where("n_chars > 0")
    return d.select("doc_id", F.explode(X.split_oversized(F.lit(0).cast("long"), F.col("n_chars"), 400)).alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


CHUNKS_SQL = f"""{SPANS_SQL},
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k, b, e FROM (SELECT doc_id, unnest(range(start, stop, 100)) AS b, least(b + 100, stop) AS e FROM spans)),
walk AS (SELECT doc_id, k, b AS head, b, e, 1 AS chunk FROM parts WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN p.e - w.head > 100 THEN p.b ELSE w.head END, p.b, p.e, CASE WHEN p.e - w.head > 100 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.k = w.k + 1),
chunks AS (SELECT doc_id, chunk, CAST(min(b) AS INT) AS start, CAST(max(e) AS INT) AS stop FROM walk GROUP BY doc_id, chunk)"""


def chunk_rows(spark, sf, size=100):
    """(doc_id, source, chunk_index from 0, start, stop, chunk_text) of every document."""
    d = t(spark, sf, "documents")
    packed = d.select("doc_id", "source", "text", X.chunk_spans(F.col("text"), F.lit(size)).alias("p"))
    spans = packed.select("doc_id", "source", "text", F.posexplode("p").alias("chunk_index", "s"))
    return spans.select("doc_id", "source", "chunk_index", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("chunk_text"))


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT c.doc_id, CAST(chunk - 1 AS INT) AS chunk_index, start, stop, md5(substr(text, start + 1, stop - start)) AS chunk_md5 FROM chunks c JOIN documents d USING (doc_id)")
def pack_chunks(spark, sf):
    return chunk_rows(spark, sf).select("doc_id", "chunk_index", "start", "stop", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT c.doc_id, CAST(chunk - 1 AS INT) AS chunk_index, start, stop FROM chunks c")
def pack_chunks_udtf(spark, sf):
    """The table function in a lateral join; with no overlap it gives what pack_chunks gives."""
    X.register_pack_chunks(spark)
    t(spark, sf, "documents").createOrReplaceTempView("storyloom_texts")
    return spark.sql("SELECT doc_id, c.chunk_index, c.start, c.stop FROM storyloom_texts, LATERAL pack_chunks(text, 100, 0) c")


@query("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_udf(spark, sf):
    """Each vector with the next one."""
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    j = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("other"), F.round(X.cosine("a.embedding", "b.embedding"), 6).alias("cosine"))


LINES_SQL = f"""l AS (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS p, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM (SELECT doc_id, unnest({SENT_SQL}) AS s, generate_subscripts({SENT_SQL}, 1) AS i FROM documents)),
c AS (SELECT doc_id, i, j, trim(p) AS p, unnest(range(0, CAST(floor((length(trim(p)) - 1) / 200) AS INT) + 1)) AS k FROM l WHERE trim(p) <> ''),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS line_no, substr(p, CAST(k * 200 + 1 AS INT), 200) AS line FROM c)"""


def line_rows(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(X.line_parts(F.col("text"))).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, md5(line) AS line_md5 FROM lines")
def split_lines(spark, sf):
    return line_rows(spark, sf).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, 'L' || line_no || ': ' || line AS shown FROM lines")
def number_lines(spark, sf):
    return line_rows(spark, sf).select("doc_id", "line_no", F.concat(F.lit("L"), "line_no", F.lit(": "), "line").alias("shown"))


@query(f"""WITH RECURSIVE {LINES_SQL}, w AS (SELECT doc_id, line_no, length('L' || line_no || ': ' || line) AS n FROM lines),
walk AS (SELECT doc_id, line_no, n AS held, 1 AS piece FROM w WHERE line_no = 1 UNION ALL
  SELECT w.doc_id, w.line_no, CASE WHEN k.held + w.n > 3000 THEN w.n ELSE k.held + w.n END, CASE WHEN k.held + w.n > 3000 THEN k.piece + 1 ELSE k.piece END FROM walk k JOIN w ON w.doc_id = k.doc_id AND w.line_no = k.line_no + 1)
SELECT doc_id, piece, count(*) AS n_lines, min(line_no) AS first_line FROM walk GROUP BY doc_id, piece""")
def pack_pieces(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", X.pack_pieces(F.col("text")).alias("p"))
    d = d.select("doc_id", F.posexplode("p").alias("pos", "piece"))
    return d.groupBy("doc_id", "piece").agg(F.count("*").alias("n_lines"), (F.min("pos") + 1).cast("long").alias("first_line"))


@query("SELECT doc_id, CAST(greatest(20, n_chars // 30) AS INT) AS cap FROM documents")
def claim_cap(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.claim_cap(F.col("n_chars")).alias("cap"))


@query("SELECT p_partkey, CAST(p_size * 60 + p_partkey % 60 AS DOUBLE) AS a, round(p_size * 3600 + (p_partkey % 1000) * 0.001, 6) AS b, NULL::DOUBLE AS c FROM part")
def parse_duration(spark, sf):
    p = t(spark, sf, "part")
    a = F.concat("p_size", F.lit("m"), F.col("p_partkey") % 60, F.lit("s"))
    b = F.concat("p_size", F.lit("h"), F.col("p_partkey") % 1000, F.lit("ms"))
    return p.select("p_partkey", X.parse_duration(a).alias("a"), F.round(X.parse_duration(b), 6).alias("b"), X.parse_duration(F.col("p_name")).alias("c"))


@query(r"SELECT doc_id, CASE WHEN length(s) > 24 THEN substr(s, 1, 24) || '…' ELSE s END AS label FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents)")
def short_label(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.short_label(F.col("text")).alias("label"))


@query(f"""WITH g AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(n) - 2, 1) + 1), lambda i: substr(n, i, 3))) AS g FROM (SELECT item_id AS id, {norm_sql('text')} AS n FROM benchmark)), c AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(n) - 2, 1) + 1), lambda i: substr(n, i, 3))) AS g FROM (SELECT doc_id AS id, {norm_sql('text')} AS n FROM documents)),
x AS (SELECT a.id AS item_id, b.id AS other, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS total FROM g a, c b)
SELECT item_id, other AS nearest, round(common / (total - common), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(common / (total - common), 6) DESC, other) AS r FROM x WHERE common > 0) WHERE r = 1""")
def trigram_jaccard(spark, sf):
    """The nearest document of each benchmark passage by trigrams; the passages' trigrams, of a checked number, go to the documents."""
    asked = t(spark, sf, "benchmark").select("item_id", X.trigrams(F.col("text")).alias("g")).select("item_id", F.size("g").alias("n"), F.explode("g").alias("w"))
    own = t(spark, sf, "documents").select("doc_id", X.trigrams(F.col("text")).alias("g")).select("doc_id", F.size("g").alias("m"), F.explode("g").alias("w"))
    pairs = own.join(S.sized(asked), "w").groupBy("item_id", "doc_id", (F.col("n") + F.col("m")).alias("total")).agg(F.count("*").alias("both"))
    scored = pairs.select("item_id", F.col("doc_id").alias("nearest"), F.round(F.col("both") / (F.col("total") - F.col("both")), 6).alias("score"))
    return S.top_k(scored, "item_id", [F.desc("score"), "nearest"], 1).select("item_id", "nearest", "score")


@query("SELECT p_partkey, round(1.0 - levenshtein(p_name, p_type || ' ' || p_brand) / greatest(length(p_name), length(p_type || ' ' || p_brand), 1), 6) AS sim FROM part")
def name_similarity(spark, sf):
    """Each name with its alias; names are compared with one another by fuzzy_pairs."""
    return t(spark, sf, "part").select("p_partkey", F.round(X.name_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand")), 6).alias("sim"))


@query()
def wratio(spark, sf):
    """The blended ratio of each name with its words turned round and a part of its alias; checked against brute force in tests."""
    alias = F.concat_ws(" ", F.array_join(F.reverse(F.split("p_name", " ")), " "), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, F.repeat(F.col("p_type"), 3)))
    return t(spark, sf, "part").select("p_partkey", alias.alias("alias"), F.round(ratios.wratio("p_name", alias), 6).alias("sim"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END AS role, length(coalesce(text, '')) AS n FROM conversations")
def clean_turns(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user").alias("role"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_text, count(*) <= 2 AS is_first FROM conversations GROUP BY conv_id")
def first_user_turn(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_text"), F.count("*").alias("n"))
    return c.select("conv_id", "first_text", (F.col("n") <= 2).alias("is_first"))


QAV_SQL = """SELECT p_partkey, list_filter([CASE WHEN a = '' AND q <> '' THEN 'hybrid_search|' || q END, CASE WHEN a = '' AND q <> '' THEN 'fact_search|' || q END, CASE WHEN a <> '' THEN 'hybrid_search|' || a END, CASE WHEN a <> '' THEN 'fact_search|' || a END,
CASE WHEN a <> '' AND v <> '' THEN 'hybrid_search|' || a || ': ' || v END, CASE WHEN a <> '' AND v <> '' THEN 'fact_search|' || a || ': ' || v END], lambda x: x IS NOT NULL) AS c
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS a, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS v, p_name AS q FROM part)"""


def part_claims(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("axis"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("value"), F.col("p_name").alias("quote"), "p_size")


def routed(df, calls):
    return df.select("p_partkey", F.posexplode(calls).alias("k", "c")).select("p_partkey", F.col("k").cast("long").alias("channel"), F.concat_ws("|", "c.tool", "c.query_text").alias("call"))


@query(f"SELECT p_partkey, generate_subscripts(c, 1) - 1 AS channel, unnest(c) AS call FROM ({QAV_SQL})")
def route_qav(spark, sf):
    return routed(part_claims(spark, sf), rules.route_qav(F.col("axis"), F.col("value"), F.col("quote")))


TYPE_SQL = """SELECT p_partkey, list_filter(CASE p_size % 4
WHEN 0 THEN ['fact_search|' || CASE WHEN a <> '' THEN a ELSE q END] WHEN 1 THEN ['hybrid_search|' || trim(a || ' ' || v), 'fact_search|' || CASE WHEN a <> '' THEN a ELSE v END]
WHEN 2 THEN ['entity_search|' || q, 'fact_search|' || trim(q || ' ' || a)] ELSE ['entity_search|' || q, 'hybrid_search|' || trim(q || ' ' || a || ' ' || v)] END, lambda x: x IS NOT NULL) AS c
FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS a, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS v, p_name AS q FROM part)"""


@query(f"SELECT p_partkey, generate_subscripts(c, 1) - 1 AS channel, unnest(c) AS call FROM ({TYPE_SQL})")
def route_type(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("deed", "rule", "state", "property"))), (F.col("p_size") % 4 + 1).cast("int"))
    return routed(part_claims(spark, sf), rules.route_type(kind, F.col("quote"), F.col("axis"), F.col("value"), F.col("quote")))


def _broadcast_sql(slim: bool) -> str:
    return f"""SELECT p_partkey, generate_subscripts(c, 1) - 1 AS channel, unnest(c) AS call FROM (SELECT p_partkey, list_filter([CASE WHEN b <> '' THEN 'entity_search|' || b END, 'hybrid_search|' || q, 'fact_search|' || q, CASE WHEN d THEN 'hybrid_search|' || s END, CASE WHEN d AND {not slim} THEN 'fact_search|' || s END], lambda x: x IS NOT NULL) AS c
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS b, p_name AS q, CASE WHEN p_size % 5 = 0 THEN replace(p_name, ' ', '') ELSE p_type END AS s, p_size % 5 <> 0 AS d FROM part))"""


def _broadcast(spark, sf, slim):
    c = part_claims(spark, sf)
    return routed(c, rules.route_broadcast(F.col("value"), F.when(F.col("axis") == "", F.regexp_replace("quote", " ", "")).otherwise(F.col("axis")), F.col("quote"), slim))


@query(_broadcast_sql(False))
def route_broadcast(spark, sf):
    return _broadcast(spark, sf, False)


@query(_broadcast_sql(True))
def route_slim(spark, sf):
    return _broadcast(spark, sf, True)


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 40 AS INT) WHEN event_id % 3 = 1 THEN CAST(event_id % 20 AS INT) END AS claim_index, CASE WHEN event_id % 5 = 0 THEN (event_id % 14)::VARCHAR WHEN event_id % 7 = 0 THEN 'high' ELSE (event_id % 15 - 2)::VARCHAR END AS raw FROM events WHERE event_id % 11 <> 0)
SELECT event_id, claim_index, CAST(least(10, greatest(0, coalesce(TRY_CAST(raw AS INT), 0))) AS INT) AS score, CASE WHEN raw = 'high' THEN 'score_not_int' WHEN raw::INT NOT BETWEEN 0 AND 10 THEN 'score_out_of_range' ELSE '' END AS flags, NULL AS problem FROM v WHERE claim_index IS NOT NULL
UNION ALL SELECT event_id, NULL, NULL, NULL, 'bad_index' FROM events, range(2) r(k) WHERE event_id % 11 <> 0 AND event_id % 3 = 2 AND (k = 0 OR event_id % 5 = 0) UNION ALL SELECT event_id, NULL, NULL, NULL, 'json_parse_failed' FROM events WHERE event_id % 11 = 0""")
def verdict_parse(spark, sf):
    """Verdict JSON made from events and read back: 'P12' and i, scores out of range or no numbers, the last of two for one claim, broken JSON."""
    e = t(spark, sf, "events")
    cid = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("P"), F.col("event_id") % 40 + 1))
    i = F.when(F.col("event_id") % 3 == 1, (F.col("event_id") % 20 + 1).cast("string")).otherwise("x")
    score = F.when(F.col("event_id") % 7 == 0, "high").otherwise((F.col("event_id") % 15 - 2).cast("string"))
    said = lambda x: F.struct(cid.alias("claimId"), i.alias("i"), x.alias("score"))
    verdicts = F.when(F.col("event_id") % 5 == 0, F.array(said(score), said((F.col("event_id") % 14).cast("string")))).otherwise(F.array(said(score)))
    raw = e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(verdicts.alias("verdicts")))).alias("raw"))
    v, problems = V.parse_verdicts(raw, ["event_id"])
    no = lambda kind: F.lit(None).cast(kind)
    return v.select("event_id", "claim_index", "score", F.array_join("flags", ",").alias("flags"), no("string").alias("problem")).union(problems.select("event_id", no("int"), no("int"), no("string"), "problem"))


@query("SELECT p_partkey, k AS claim_no, CASE WHEN k = 0 THEN p_name ELSE p_type END AS quote, p_brand AS axis FROM part, (VALUES (0::BIGINT), (1::BIGINT)) v(k) WHERE p_size % 6 <> 0")
def claim_parse(spark, sf):
    """Claim JSON made from parts and read back; a null list has no claim."""
    claim = lambda q: F.struct(F.col(q).alias("quote"), F.col("p_brand").alias("axis"), F.lit(None).cast("string").alias("value"), F.array(F.col("p_size")).alias("lines"))
    raw = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 0, F.lit('{"claims": null}')).otherwise(F.to_json(F.struct(F.array(claim("p_name"), claim("p_type")).alias("claims")))).alias("raw"))
    c = raw.select("p_partkey", F.posexplode(F.coalesce(F.from_json("raw", rules.CLAIMS)["claims"], F.array())).alias("k", "c"))
    return c.select("p_partkey", F.col("k").cast("long").alias("claim_no"), F.col("c.quote").alias("quote"), F.col("c.axis").alias("axis"))


@query("""SELECT 'node' AS kind, sha256(o_custkey || '#' || o_orderkey || '#n' || k) AS a, NULL AS b, CASE WHEN k = 0 THEN 'Character' ELSE 'Event' END AS label, CASE WHEN k = 0 THEN 'c' || o_custkey ELSE o_orderpriority END AS name FROM orders, (VALUES (0), (1)) v(k) WHERE o_orderkey % 9 <> 0
UNION ALL SELECT 'edge', sha256(o_custkey || '#' || o_orderkey || '#n0'), sha256(o_custkey || '#' || o_orderkey || '#n1'), 'APPEARS_IN', NULL FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'no_json', NULL, NULL, NULL, o_custkey || '#' || o_orderkey FROM orders WHERE o_orderkey % 9 = 0""")
def graph_parse(spark, sf):
    """Graph JSON made from orders and read back, nodes and edges; ids are digests of tenant, chapter and local id. One reply in nine is no JSON."""
    node = lambda i, label, name: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.create_map(F.lit("name"), name).alias("properties"))
    made = F.to_json(F.struct(F.array(node("n0", "Character", F.concat(F.lit("c"), "o_custkey")), node("n1", "Event", F.col("o_orderpriority"))).alias("nodes"), F.array(F.struct(F.lit("APPEARS_IN").alias("type"), F.lit("n0").alias("start_node_id"), F.lit("n1").alias("end_node_id"))).alias("relationships")))
    raw = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("tenant"), F.col("o_orderkey").cast("int").alias("chapter"), F.when(F.col("o_orderkey") % 9 == 0, "{").otherwise(made).alias("raw"))
    nodes, edges, pruned = parsed(raw)
    no = F.lit(None).cast("string")
    out = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), no.alias("b"), "label", "name").union(edges.select(F.lit("edge"), "src", "dst", "type", no))
    return out.union(pruned.where("reason = 'no_json'").select(F.lit("no_json"), no, no, no, F.concat_ws("#", "tenant", "chapter")))
