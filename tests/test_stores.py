"""Stored postings, stored vector cells, files of artifacts, states at a chapter, intervals and short names against brute force."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import joins as J
from storyloom.operators import search as S
from storyloom.operators.cells import VectorCells
from storyloom.operators.postings import Postings
from storyloom.sources import artifacts as A


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.node_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in which one word stands everywhere and others are rare, of which some are short and full of them."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(["the"] * rng.randint(1, 30) + rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 60))), rng.choice([None, 1, 5, 9])) for i in range(3000)]
    rows += [(5000 + i, f"w{i} w{i} w{i + 1}", i % 7) for i in range(40)] + [(6000, None, 1), (6001, "", 1), (6002, "한국어 단어", None)]
    return spark.createDataFrame(rows, "node_id long, text string, chapter int")


@pytest.mark.parametrize("cut", [False, True])
def test_stored_postings_find_what_a_scan_finds(spark, corpus, tmp_path, cut):
    index = Postings(spark, f"file://{tmp_path}/p", parts=8)
    for i in range(3):
        index.add(corpus.where(f"node_id % 3 = {i}"))
    asked = [(1, "w5 the", 6), (2, "w250 w3 the w17", 2), (3, "nowhere", 5), (4, "", None), (5, "한국어", None), (6, "the", 9), (7, "w1 w2", None)]
    q = spark.createDataFrame(asked, "query_id long, text string, up_to int")
    q = q if cut else q.drop("up_to")
    want = S.fulltext_topk(q, corpus if cut else corpus.drop("chapter"), 5)
    assert rows_of(index.search(q, 5)) == rows_of(want)
    if not cut:
        assert index.read_blocks < 0.8 * index.all_blocks
    weighed, blocks = index.plan(q.where("query_id = 5"), 5)
    scan = blocks.join(F.broadcast(weighed.select("term", "part")), ["term", "part"])._jdf.queryExecution().simpleString()
    assert "PartitionFilters" in scan and "part" in scan.split("PartitionFilters")[1][:200]


def test_a_bundle_of_postings_adds_files_only(spark, corpus, tmp_path):
    import os

    index = Postings(spark, f"file://{tmp_path}/p", parts=4)
    files = lambda: {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(f"{tmp_path}/p") for f in names if f.endswith(".parquet")}
    index.add(corpus.where("node_id < 100"))
    before = files()
    index.add(corpus.where("node_id BETWEEN 100 AND 200"))
    assert before < files()
    assert index.read("totals").agg(F.sum("n")).first()[0] == corpus.where("node_id <= 200 AND text <> ''").count()
    assert Postings(spark, f"file://{tmp_path}/none").search(spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).count() == 0


def clustered(rng, n=4000, size=16, groups=40):
    centre = rng.normal(size=(groups, size)) * 3
    return centre[rng.integers(groups, size=n)] + rng.normal(size=(n, size)) * 0.2


@pytest.mark.parametrize("cut", [False, True])
def test_stored_cells_find_what_a_scan_finds(spark, tmp_path, cut):
    rng = np.random.default_rng(3)
    x = clustered(rng)
    rows = [(i, v.tolist(), int(rng.integers(10)) if i % 3 else None) for i, v in enumerate(x)] + [(9000, [0.0] * 16, None), (9001, None, 1), (9002, [float("nan")] * 16, 1), (9003, x[5].tolist(), None)]
    vectors = spark.createDataFrame(rows, "node_id long, vec array<double>, chapter int")
    index = VectorCells(spark, f"file://{tmp_path}/c")
    for i in range(2):
        index.add(vectors.where(f"node_id % 2 = {i}"))
    asked = [(i, (x[i * 7] + rng.normal(size=16) * 0.01).tolist(), int(rng.integers(1, 10)) if i % 2 else None) for i in range(50)] + [(98, [0.0] * 16, None), (99, (-x[0]).tolist(), 3), (100, None, 1)]
    q = spark.createDataFrame(asked, "query_id long, vec array<double>, up_to int")
    q = q if cut else q.drop("up_to")
    assert rows_of(index.search(q, 4)) == rows_of(S.vector_topk(q, vectors if cut else vectors.drop("chapter"), 4))
    assert index.cells_read < 0.4 * index.cells_all


def test_cells_of_nothing_and_of_another_length(spark, tmp_path):
    index, schema = VectorCells(spark, f"file://{tmp_path}/c"), "node_id long, vec array<double>"
    assert index.add(spark.createDataFrame([(1, None)], schema)) == 0
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert index.search(q, 2).count() == 0
    index.add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema))
    with pytest.raises(ValueError, match="2 components"):
        index.add(spark.createDataFrame([(3, [1.0])], schema))
    assert rows_of(index.search(q, 2)) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0)]


def test_files_of_drafts_and_runs_are_found_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    v1 = json.dumps({"draft": "v1", "note": "n", "errors": [{"quote": "q1", "category": "c", "established_in_chapters": [3]}, {"quote": "q2"}], "hard_negatives": [{"quote": "h", "reason": "r"}], "excluded": []}, indent=1)
    files = [("v1.gt.json", v1), ("v 2.gt.json", '{"errors": [{"quote": "한국"}]}'), ("bad.gt.json", "{"), ("claims_r1_v1.json", "{}"), ("claims_r1_v2.json", "{}"), ("evidence_r1_v1.json", "{}"), ("evidence_r1_v2.json", "{}"), ("claims_r2_v1.json", "{}"), ("evidence_r2_v1.json", "{}"), ("evidence_r3_v1.json", "{}"), ("evidence_r3_v2.json", "{}"), ("notes.json", "{}")]
    A.put_named(spark.createDataFrame(files, "name string, body string"), path)
    A.put_named(spark.createDataFrame(files[:1], "name string, body string"), path)
    truths, broken = A.ground_truth(spark, path)
    got = sorted((r.draft, r.kind, r.gid, r.quote, r.chapters) for r in truths.collect() if r.gid) + [(r.draft, r.kind, r.quote) for r in truths.collect() if not r.gid]
    assert got == [("v 2", "error", "v 2-GT1", "한국", None), ("v1", "error", "v1-GT1", "q1", [3]), ("v1", "error", "v1-GT2", "q2", None), ("v1", "hard_negative", "h")]
    assert [r.file_name for r in broken.collect()] == ["bad.gt.json"]
    drafts = spark.createDataFrame([("v1",), ("v2",)], "draft string")
    assert [r.run for r in A.complete_runs(spark, path, drafts).collect()] == ["r1"]


def test_state_as_of_each_requests_own_chapter(spark):
    rng = random.Random(4)
    states = [(rng.randrange(6), rng.choice([None, *range(8)]), i, rng.choice([None, 0.5, 1.5])) for i in range(80)]
    asked = [(i, rng.randrange(8), rng.choice([None, *range(-1, 10)])) for i in range(200)] + [(200, None, 3)]
    got = J.state_as_of(spark.createDataFrame(asked, "query_id int, k int, up_to int"), spark.createDataFrame(states, "k int, chapter int, state int, story_order double"), "k", ["state"], ["story_order", "state"])
    order = lambda s: (s[1] is not None, s[1] or 0, s[3] is not None, s[3] or 0, s[2])
    want = {}
    for i, k, up_to in asked:
        own = [s for s in states if s[0] == k and (s[1] is None or up_to is None or s[1] < up_to)]
        want[i] = max(own, key=order)[2] if own and k is not None else None
    assert {r.query_id: r.state for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_intervals_meet_by_bins(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.randrange(3), a, a + rng.choice([0, 1, 5, 40])) for a in (rng.randrange(200) for _ in range(n))]
    one, two = [(i, *r) for i, r in enumerate(make(60))], [(i, *r) for i, r in enumerate(make(60))]
    a, b = spark.createDataFrame(one, "i int, k int, a_from int, a_to int"), spark.createDataFrame(two, "j int, k int, b_from int, b_to int")
    want = sorted((i, j) for i, k, p, q in one for j, m, r, s in two if k == m and max(p, r) < min(q, s))
    for width in (1, 7, 512):
        assert sorted((r.i, r.j) for r in J.overlapping(a, b, "k", width).collect()) == want


def test_short_names_meet_by_deletions(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("ab가나다") for _ in range(rng.randint(1, 9))) for _ in range(260)})
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "node_id long, name string").withColumn("k", F.lit(1))
    for threshold in (0.7, 0.75, 0.85, 0.65):
        a, b = ({(r.a, r.b) for r in S.fuzzy_pairs(df, X.name_similarity, threshold, ["k"], n).collect()} for n in (10_000, 0))
        assert a == b and (a or threshold > 0.8)


def test_unlike_short_names_are_not_compared(spark):
    letters = [chr(0xAC00 + 28 * i) for i in range(300)]
    rng = random.Random(9)
    names = {"".join(rng.sample(letters, 3)) for _ in range(2000)}
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sorted(names))], "node_id long, name string")
    variants = df.select("node_id", F.explode(S.shortened(F.col("name"), F.lit(1))).alias("v"))
    met = variants.alias("a").join(variants.alias("b"), "v").where("a.node_id < b.node_id").count()
    assert met < 2000


def test_the_last_row_of_a_key_stays_whatever_comes_when(spark, tmp_path):
    from storyloom.sources.tables import put_latest

    rng, path, schema = random.Random(7), f"file://{tmp_path}/s", "k int, at int, v int"
    rows = [(rng.randrange(20), i, rng.randrange(9)) for i in range(200)]
    rng.shuffle(rows)
    for i in range(0, 200, 50):
        for _ in range(2):
            got = put_latest(spark.createDataFrame(rows[i : i + 50], schema), path, ["k"], ["at"], 4)
    want = {}
    for k, at, v in rows:
        want[k] = max(want.get(k, (-1, 0)), (at, v))
    assert {r.k: (r.at, r.v) for r in got.collect()} == want
