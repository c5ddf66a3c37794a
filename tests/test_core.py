"""Rules and operators on small literal cases; a sample of queries against their SQL."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import rules
from storyloom.functions import text as X
from storyloom.operators import aggregates as A
from storyloom.operators import graph as G
from storyloom.operators import joins as J
from storyloom.operators import search as S
from storyloom.sources import tables as T
from storyloom.streaming import jobs as K

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_future_cases(spark):
    rows = [("6", 5, True), ("5", 5, True), ("4", 5, False), (None, 5, False), ("5화", 5, False)]
    for chapter, limit, future in rows:
        assert one(spark, rules.not_future(F.lit(chapter).cast("string"), limit).alias("x")).x is (not future)
    assert one(spark, rules.not_future(F.lit("6"), None).alias("x")).x is True


def test_cutoffs_treat_unknown_chapters(spark):
    null = F.lit(None).cast("int")
    r = one(spark, rules.before_chapter(null, 3).alias("a"), rules.up_to_chapter(null, 3).alias("b"), rules.up_to_chapter(null, None).alias("c"))
    assert (r.a, r.b, r.c) == (True, False, True)


def test_scores_and_lines(spark):
    for raw, score, flag in (("12", 10, "score_out_of_range"), ("-3", 0, "score_out_of_range"), ("x", 0, "score_not_int"), ("7", 7, "")):
        s, f = rules.clamp_score(F.lit(raw))
        r = one(spark, s.alias("s"), F.array_join(f, ",").alias("f"))
        assert (r.s, r.f) == (score, flag)
    for picked, candidates, want, fell in (([99], [3, 4], [3, 4], True), ([], [10], [10], True), ([21], [20, 21], [21], False)):
        array = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
        p, f = rules.picked_lines(array(picked), array(candidates))
        r = one(spark, p.alias("p"), f.alias("f"))
        assert (r.p, r.f) == (want, fell)


def test_claim_index(spark):
    for cid, i, want in (("P12", "3", 11), ("Q7", "1", 0), (None, "2", 1), (None, "x", None)):
        assert one(spark, rules.claim_index(F.lit(cid).cast("string"), F.lit(i)).alias("x")).x == want


def test_normal_forms(spark):
    r = one(spark, X.norm(F.lit("a b　c d\n")).alias("n"), X.loose(F.lit("『채널』 #BI-7!")).alias("l"), X.name_key(F.lit("<탑의 문>")).alias("k"), X.name_key(F.lit("《》")).alias("e"), X.parse_duration(F.lit("6m0s")).alias("m"), X.parse_duration(F.lit("500ms")).alias("ms"))
    assert (r.n, r.l, r.k, r.e, r.m, r.ms) == ("abcd", "채널#BI7", "탑의문", None, 360.0, 0.5)
    assert one(spark, X.evidence_tokens(F.lit("C3, C14,x1,C")).alias("x")).x == [3, 14]


@pytest.mark.parametrize("overlap", [0, 5, 10, 22, 100])
def test_chunks_are_parts_of_the_text(spark, overlap):
    text = "가나다라. 마바사아.\n자차카타. 파하가나. 다라마바."
    parts = ["가나다라.", "마바사아.", "자차카타.", "파하가나.", "다라마바."]
    places = [(text.index(p), text.index(p) + len(p)) for p in parts]
    spans = X.overlapping_chunks(places, 22, overlap)
    assert all(e - s <= 22 for s, e in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(any(p in text[s:e] for s, e in spans) for p in parts)
    if not overlap:
        r = one(spark, X.pack_spans(X.sentence_spans(X.sentences(F.lit(text))), 22).alias("x")).x
        assert [(s.start, s.end) for s in r] == spans


def test_sentences_longer_than_a_chunk(spark):
    r = one(spark, X.pack_spans(X.sentence_spans(X.sentences(F.lit("ab. " + "x" * 25 + ". c"))), 10).alias("x")).x
    assert [(s.start, s.end) for s in r] == [(0, 3), (4, 14), (14, 24), (24, 32)]
    assert one(spark, X.pack_spans(X.sentence_spans(X.sentences(F.lit(" \n"))), 10).alias("x")).x == []


def test_lost_sentences_are_left_out(spark):
    parts = F.array(*map(F.lit, ["가나다.", "원문에 없는 문장.", "라마바."]))
    assert [(s.start, s.end) for s in one(spark, X.located_spans(F.lit("가나다. 라마바."), parts).alias("x")).x] == [(0, 4), (5, 9)]


def test_pieces_close_before_the_line_that_passes_the_size(spark):
    text = "\n".join("x" * n for n in (50, 10, 20, 5, 1))
    assert one(spark, X.pack_pieces(F.lit(text), 40).alias("x")).x == [1, 2, 2, 3, 3]
    assert one(spark, X.pack_pieces(F.lit(None).cast("string"), 40).alias("x")).x == []
    odd = " a.b!\n\n  " + "y" * 450 + " . z\t?"
    assert X.lines_of(odd) == one(spark, X.line_parts(F.lit(odd)).alias("x")).x


def test_numbers_beyond_an_int_go(spark):
    assert one(spark, X.evidence_tokens(F.lit("C3,C99999999999,C4")).alias("x")).x == [3, 4]
    assert one(spark, rules.claim_index(F.lit("P99999999999"), F.lit("1")).alias("x")).x is None


def test_upper_median_and_curve(spark):
    df = spark.createDataFrame([(s, s > 4) for s in (1, 2, 3, 9)], "score int, truth boolean")
    assert df.agg(A.upper_median("score").alias("m")).first().m == 3
    assert [r.l for r in A.listed(df.selectExpr("1 AS k", "score").union(df.selectExpr("1 AS k", "score")), "k", "score", "l").collect()] == ["1,1,2,2,3,3,9,9"]
    curve = {r.tau: (r.tp, r.fp, r.alarms) for r in A.threshold_curve(df, {"tp": F.col("truth"), "fp": ~F.col("truth"), "alarms": F.lit(True)}).collect()}
    assert len(curve) == 11 and curve[0] == (1, 3, 4) and curve[9] == (1, 0, 1) and curve[10] == (0, 0, 0)


def test_roster_drops_those_who_lie_ahead(spark):
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "char_id int, name string, aliases string")
    s = spark.createDataFrame([(1, 10, "s", 9), (2, 20, "t", 1)], "char_id int, state_id int, state string, chapter int")
    g = spark.createDataFrame([(20, "sword")], "state_id int, target string")
    assert {r.name: r.states for r in J.roster(c, s, g, 5).collect()} == {"b": ["t>sword"], "c": []}


def test_citations_keep_their_order(spark):
    aliases = spark.createDataFrame([("C001", 1, 1, 0), ("C002", 2, 1, 1), ("F001", 1, 1, 0), ("F001", 3, 2, 0)], "alias string, chunk_id int, chapter int, idx int")
    cited = spark.createDataFrame([(7, ["C002", "F001", "X9", "C001"])], "claim_id int, cited array<string>")
    got = J.resolve_cited(cited, aliases).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3]


def test_hierarchy_with_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src string, dst string")
    got = {(r.node, r.ancestor) for r in G.ancestors(e).collect()}
    assert ("x", "c") in got and ("a", "c") in got and ("a", "a") not in got


def test_merge_sets_follow_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.node_id: r.component for r in S.merge_components(pairs).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100


def test_rewired_edges_have_no_loops(spark):
    e = spark.createDataFrame([("a", "IN", "b"), ("a", "IN", "c"), ("d", "IN", "b")], "src string, type string, dst string")
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("d", "a"), ("c", "c")], "node_id string, component string")
    assert [(r.src, r.dst) for r in G.rewire(e, c).collect()] == [("a", "c")]


def test_partitions_written_twice_are_the_same(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    T.put_partitions(df, str(tmp_path / "t"), "p")
    T.put_partitions(df.where("p = 'a'"), str(tmp_path / "t"), "p")
    assert T.put_partitions(df, str(tmp_path / "t"), "p").count() == 2
    with pytest.raises(Exception, match="no tenant"):
        T.stamped(df, F.lit(None).cast("string")).collect()


def test_audit_finds_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a"), ("y", "y")], "src string, dst string")
    assert {r.node for r in G.on_cycles(e).collect()} == {"a", "b"}


def test_markers_are_found_whole(spark):
    texts = spark.createDataFrame([(1, "aabcabcd"), (2, "bcd"), (3, None), (4, "")], "doc_id long, body string")
    markers = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "abcd"), (4, ""), (5, None), (6, "abc")], "marker_id long, m string")
    want = {(d, m) for d, t in ((1, "aabcabcd"), (2, "bcd")) for m, x in ((1, "abc"), (2, "bcd"), (3, "abcd"), (6, "abc")) if x in t}
    for block in (1 << 20, 4):
        assert {(r.doc_id, r.marker_id) for r in J.holding(texts, markers, block).collect()} == want


def test_vectors_that_cannot_be_compared(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, None, 5), (3, [1.0], None)], "query_id long, vec array<double>, up_to int")
    v = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [2.0], 1), (7, [1.0, 1.0], None), (8, [], 1)], "node_id long, vec array<double>, chapter int")
    assert [(r.query_id, r.node_id, round(r.score, 3)) for r in S.vector_topk(q, v, 3).orderBy("query_id", "rank").collect()] == [(1, 7, 0.707), (1, 3, 0.0), (3, 6, 1.0)]
    assert S.vector_topk(q.where("query_id = 2"), v, 3).count() == 0


def test_words_of_every_alphabet(spark):
    d = spark.createDataFrame([(1, "Łódź šest"), (2, "Москва слова"), (3, "지하철에 있다"), (4, None)], "node_id long, text string")
    q = spark.createDataFrame([(1, "łódź"), (2, "МОСКВА"), (3, "하철")], "query_id long, text string")
    assert {(r.query_id, r.node_id) for r in S.fulltext_topk(q, d, 2).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_chapters_are_cut_before_the_best_are_taken(spark):
    d = spark.createDataFrame([(i, "tower gate" if i < 9 else "tower", i) for i in range(10)], "node_id long, text string, chapter int")
    q = spark.createDataFrame([(1, "gate", 3), (2, "gate", None)], "query_id long, text string, up_to int")
    got = {(r.query_id, r.node_id) for r in S.fulltext_topk(q, d, 4).collect()}
    assert got == {(1, 0), (1, 1), (1, 2)} | {(2, i) for i in range(4)}


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_blocked_names_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(150)})
    # Pairs at both thresholds, of one key each: two edits in fifteen letters, one in eight, none but a case of seven.
    names += [x for n in ("abcabcabcabcabc", "cabbages", "aabbccd") for x in (n, n, f"{n[:3]}x{n[4:]}", f"{n[:3]}x{n[4:]}")]
    df = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "node_id long, name string, k int")
    a, b = ({(r.a, r.b, r.sim) for r in S.fuzzy_pairs(df, X.name_similarity, threshold, ["k"], n).collect()} for n in (10000, 0))
    assert a == b and a


def test_vector_pairs_by_block(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(99, 0, [0.0] * 3), (100, 0, None)]
    df = spark.createDataFrame(rows, "node_id long, label int, vec array<double>")
    a, b = ({(r.a, r.b) for r in S.vector_pairs(df, 0.85, n).collect()} for n in (2048, 7))
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    assert a == b == {(i, j) for i, li, x in rows[:60] for j, lj, y in rows[:60] if i < j and li == lj and cos(x, y) >= 0.85}


def test_a_batch_that_runs_again_writes_its_rows_again(spark, tmp_path):
    out = f"file://{tmp_path}/i"
    one_, two = (spark.createDataFrame(r, "doc_id long, source string") for r in ([(1, "a"), (2, "a")], [(2, "a"), (3, "a")]))
    K.ingested(one_, 0, out, ["doc_id"])
    for _ in range(2):
        K.ingested(two, 1, out, ["doc_id"])
    assert sorted((r.batch, r.doc_id) for r in spark.read.parquet(out).collect()) == [(0, 1), (0, 2), (1, 3)]


def quota_by_hand(rows, until):
    """What is left after all calls, and full again if the reset lies before `until`."""
    left, reset = 1000, 0
    for at, _, observed, tokens, wait in sorted(rows):
        if reset and at >= reset:
            left, reset = 1000, 0
        left, reset = (tokens, at + wait) if observed else (max(0, left - tokens), reset)
    return 1000 if reset and reset <= until else left


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_quota_follows_calls_and_resets(spark):
    from storyloom.bindings import lifecycle

    rows = lifecycle.quota_calls(spark, SF).collect()
    until = max(r.at for r in rows) - 24 * 3600 * 1000  # where the watermark ends
    want = {m: quota_by_hand([(r.at, r.event_id, r.observed, r.tokens, r.reset) for r in rows if r.model == m], until) for m in {r.model for r in rows}}
    assert {r.model: r.left_over for r in lifecycle.stream_quota(spark, SF).collect()} == want


def minutes(*values):
    from datetime import datetime, timedelta

    return [datetime(2024, 1, 1) + timedelta(minutes=m) for m in values]


def ticks(spark, tmp_path, make, schema, files, late):
    """Results of a job after each of some files, one a tick, each tick with a job of its own as after a restart; the last job."""
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/job"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/file={i}")
        job = K.Job(spark, out, "ts", late, make)
        got = job.tick(K.followed(spark, spark.createDataFrame([], schema).schema, path))
    return got, job


def shuffled_log(n=240):
    """Rows (ts, id, key) of 0 to 240 minutes in four files that overlap by up to 60 minutes, and two rows that come far too late."""
    rng = random.Random(4)
    rows = [(m, i, f"k{i % 3}") for i, m in enumerate(rng.sample(range(n), 120))]
    files = [[] for _ in range(4)]
    for m, i, k in rows:
        files[min(3, (m + rng.randrange(60)) // 60)].append((minutes(m)[0], i, k))
    for f in files:
        rng.shuffle(f)
    stray = [(minutes(1)[0], 900, "k0"), (minutes(2)[0], 901, "k1")]
    files[3] += stray
    return rows, files, stray


def test_windows_over_unordered_files_lose_no_row(spark, tmp_path):
    rows, files, stray = shuffled_log()
    make = lambda r: K.windowed(r, "ts", "60 minutes", F.window("ts", "30 minutes"), ["key"], "id")
    got, job = ticks(spark, tmp_path, make, "ts timestamp, id long, key string", files, "60 minutes")
    end = max(m for m, _, _ in rows) - 60
    want = {}
    for m, i, k in rows:
        if m // 30 * 30 + 30 <= end:
            n, total = want.get((m // 30 * 30, k), (0, 0))
            want[m // 30 * 30, k] = n + 1, total + i
    have = {(int((r.window.start - minutes(0)[0]).total_seconds() // 60), r.key): (r.n, r.total) for r in got.collect()}
    assert have == want
    assert sorted((r.ts, r.id, r.key) for r in job.late_rows().collect()) == stray


def test_dedupe_over_unordered_files(spark, tmp_path):
    rows, files, stray = shuffled_log()
    again = [files[0], files[1] + [r for r in files[0] if r[0] >= minutes(50)[0]], files[2], files[3]]
    make = lambda r: K.dedupe(r, ["id"], "ts", "60 minutes")
    got, job = ticks(spark, tmp_path, make, "ts timestamp, id long, key string", again, "60 minutes")
    ids = [r.id for r in got.collect()]
    assert sorted(ids) == sorted(i for _, i, _ in rows)
    assert sorted((r.ts, r.id, r.key) for r in job.late_rows().collect()) == stray


def test_quota_over_unordered_files(spark, tmp_path):
    from storyloom.bindings import lifecycle

    rng = random.Random(9)
    start = 1_704_067_200_000  # minutes(0) in milliseconds
    calls = [(i, f"m{i % 3}", start + m * 60000, minutes(m)[0], rng.random() < 0.1, rng.randrange(80), rng.randrange(20) * 60000) for i, m in enumerate(rng.sample(range(4000), 400))]
    files = [[] for _ in range(4)]
    for c in calls:
        files[min(3, ((c[2] - start) // 60000 + rng.randrange(900)) // 1000)].append(c)
    schema = "event_id long, model string, at long, ts timestamp, observed boolean, tokens long, reset long"
    got, job = ticks(spark, tmp_path, lambda r: K.stateful(r.withWatermark("ts", "1 day"), "model", K.Quota(), "model string, at long, n long, restored boolean, left_over long", "eventTime"), schema, files, "1 day")
    until = max(c[2] for c in calls) - 24 * 3600 * 1000
    want = {m: quota_by_hand([(c[2], c[0], c[4], c[5], c[6]) for c in calls if c[1] == m], until) for m in ("m0", "m1", "m2")}
    assert {r.model: r.left_over for r in lifecycle.balances(got).collect()} == want
    assert job.late_rows().count() == 0 and got.agg(F.max("n")).first()[0] > 100


def test_order_of_chapters_is_kept_over_batches(spark, tmp_path):
    path, schema = f"file://{tmp_path}/turns", "conv_id long, turn long"
    for i, rows in enumerate([[(1, 0), (1, 1), (2, 0)], [(1, 3), (2, 1)], [(1, 2), (2, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/file={i}")
        rows_ = K.followed(spark, spark.createDataFrame([], schema).schema, path)
        got = K.drained(K.stateful(rows_, "conv_id", K.Continuity(), "conv_id long, turn long, admitted boolean"), f"file://{tmp_path}/out")
    assert {(r.conv_id, r.turn): r.admitted for r in got.collect()} == {(1, 0): True, (1, 1): True, (2, 0): True, (1, 3): False, (2, 1): True, (1, 2): True, (2, 2): True}


def core():
    import __spark_entry__ as entry

    return [q for q in entry.oracle_sql() if not q.startswith("op")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", core())
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry
    import devcheck

    got = entry.queries()[name](spark, SF).toPandas()
    want = devcheck.duck(SF).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and devcheck.canon(got) == devcheck.canon(want)


def test_every_query_has_sql_but_these():
    import __spark_entry__ as entry

    bare = {q for q in entry.queries() if q not in entry.oracle_sql() and not q.startswith("op") and q != "pipeline"}
    assert bare == {"stream_quota", "wratio"}


def test_a_job_or_chapter_written_again_leaves_the_others(spark, tmp_path):
    rows = [(j, s, j * 100 + s) for j in range(40) for s in range(j % 4 + 1)]
    schema, path = "job_id long, seq int, event_id int", f"file://{tmp_path}/findings"
    T.put_keys(spark.createDataFrame(rows, schema), path, ["job_id"], buckets=4)
    again = [(7, 0, -1), (12, 0, -2), (12, 1, -3), (99, 0, -4)]
    for _ in range(2):
        got = T.put_keys(spark.createDataFrame(again, schema), path, ["job_id"], buckets=4)
        assert sorted(tuple(r) for r in got.select("job_id", "seq", "event_id").collect()) == sorted([r for r in rows if r[0] not in (7, 12)] + again)
    chunks = [(w, n, f"{w}-{n}-{i}") for w in ("a", "b") for n in range(5) for i in range(3)]
    schema, path = "tenant string, chapter int, chunk_id string", f"file://{tmp_path}/chunks"
    T.put_keys(spark.createDataFrame(chunks, schema), path, ["tenant", "chapter"], ["tenant"], 2)
    got = T.put_keys(spark.createDataFrame([("a", 2, "new")], schema), path, ["tenant", "chapter"], ["tenant"], 2)
    assert sorted(r.chunk_id for r in got.collect()) == sorted([c for w, n, c in chunks if (w, n) != ("a", 2)] + ["new"])


def test_numbers_of_tokens_may_have_leading_zeros(spark):
    assert one(spark, X.evidence_tokens(F.lit("C0000000000000000012, C0, C99999999999999999999, C07,c8,C")).alias("x")).x == [12, 0, 7]
