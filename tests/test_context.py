"""Rendered context, verdicts, findings and retrieval on small literal graphs."""

from __future__ import annotations

import json

from storyloom.operators import context as C
from storyloom.operators import retrieval as Q
from storyloom.operators import verdicts as V

NODES = "tenant string, node_id string, label string, name string, chapter int, story_order double, extras string"


def small_graph(spark):
    nodes = [
        ("t", "c1", "Character", "Dokja", None, None, "aliases=reader"), ("t", "c2", "Character", "Ara", None, None, ""), ("t", "s1", "CharacterState", "hurt", None, None, ""), ("t", "s2", "CharacterState", "armed", None, None, ""),
        ("t", "s3", "CharacterState", "lost", 4, None, ""), ("t", "e1", "Event", "fight", 2, 2.1, ""), ("t", "e2", "Event", "dawn", None, None, ""), ("t", "l1", "Location", "Gate", None, None, ""), ("t", "l2", "Location", "City", None, None, "description=old"),
        ("t", "i1", "Item", "Sword", None, None, ""), ("u", "x1", "Item", "Coin", None, None, ""),
    ]
    edges = [("c1", "HAS_STATE", "s1"), ("c1", "HAS_STATE", "s2"), ("s1", "ESTABLISHED_IN", "e1"), ("s2", "ABOUT", "i1"), ("s2", "ABOUT", "c2"), ("c1", "APPEARS_IN", "e1"), ("c2", "APPEARS_IN", "e1"), ("l1", "HOSTS", "e1"), ("l1", "LOCATED_IN", "l2"), ("c2", "KNOWS", "i1")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([("t", *e) for e in edges], "tenant string, src string, type string, dst string")


def test_the_graph_as_text(spark):
    got = {r.tenant: r.text for r in C.graph_text(*small_graph(spark)).collect()}
    assert got["t"].split("\n") == [
        "## 인물", "- (Character) Ara", "  · 관계: KNOWS → Item:Sword", "- (Character) Dokja — aliases=reader", "  · 상태: armed (대상: Ara, Sword)", "  · 상태: hurt (2화 성립)", "- (CharacterState, 소유자 미상) lost (4화 성립)",
        "## 사건", "- (Event) dawn", "- (Event) fight (2화 #2.1, 장소: Gate, 참여: Ara, Dokja)", "## 사물·장소·조직", "- (Item) Sword", "- (Location) City — description=old", "- (Location) Gate (상위: City)",
    ]
    assert got["u"] == "## 사물·장소·조직\n- (Item) Coin"


def test_the_story_so_far_leaves_out_what_is_empty(spark):
    stories = spark.createDataFrame([("t", "long ago"), ("v", "")], "tenant string, summary string")
    summaries = spark.createDataFrame([("t", n, f"s{n}") for n in range(1, 6)] + [("w", 1, None)], "tenant string, chapter int, summary string")
    got = {r.tenant: r.context for r in C.story_context(stories, summaries, C.graph_text(*small_graph(spark))).collect()}
    assert got["t"].startswith("# 지금까지의 전체 줄거리(압축)\nlong ago\n\n# 최근 회차 요약\n[3화] s3\n[4화] s4\n[5화] s5\n\n# 지금까지의 그래프\n## 인물")
    assert got["v"] == "" and got["u"].startswith("# 지금까지의 그래프")


def test_sources_and_references_of_claims(spark):
    chunks = spark.createDataFrame([(1, "C2", 3, 0, "text b"), (1, "C1", 2, 1, "text a"), (2, "C1", 1, 0, None)], "job int, alias string, chapter int, idx int, text string")
    facts = spark.createDataFrame([(1, "F1", "Event", 2, 2.5, "fight", "hard", ["Ara"], ["Gate(Location)"], ["C2", "C1"]), (1, "F2", "CharacterState", None, None, "hurt", "", [], [], [])], "job int, alias string, label string, chapter int, story_order double, name string, description string, participants array<string>, related array<string>, evidence array<string>")
    entities = spark.createDataFrame([(1, "E1", "Character", "Ara", ["A"], "", ["Dokja(ABOUT)"], ["City"])], "job int, alias string, label string, name string, aliases array<string>, description string, related array<string>, parents array<string>")
    got = {r.job: r.text for r in C.source_document(chunks, facts, entities).collect()}
    assert got[1].split("\n") == ["[문서고 · 원문 청크]", "C1 (2화#1) text a", "C2 (3화#0) text b", "", "[문서고 · 사실]", "F1 (Event · 2화 · 순서 2.5) fight — hard", "     참가자: Ara", "     연관: Gate(Location)", "     근거: C1 C2", "F2 (CharacterState · -화) hurt", "", "[문서고 · 개체]", "E1 (Character) Ara [별칭: A]", "     관련인물: Dokja(ABOUT)", "     상위: City"]
    assert got[2].split("\n") == ["[문서고 · 원문 청크]", "C1 (1화#0) ", "", "[문서고 · 사실]"]
    claims = spark.createDataFrame([(1, 1, "P1", "q", "a / v", [3, 4]), (1, 2, None, "r", "b", None), (2, 1, "P1", "s", "", [])], "job int, n int, claim_id string, quote string, described string, lines array<int>")
    refs = spark.createDataFrame([(1, 1, "C", "C2"), (1, 1, "C", "C1"), (1, 1, "C", "C1"), (1, 1, "E", "E1"), (2, 1, "F", "F9")], "job int, n int, kind string, alias string")
    lines = {r.job: r.text.split("\n") for r in C.text_of(C.reference_lines(claims, refs), "job").collect()}
    assert lines[1] == ["[claim별 참조]", 'P1 "q" (a / v) [줄 3, 4]  → C1 C2 | - | E1', '#2 "r" (b)  → - | - | -'] and lines[2] == ["[claim별 참조]", 'P1 "s" ()  → - | F9']


def replies(spark, *raws):
    return spark.createDataFrame([(1, s, 0, r) for s, r in enumerate(raws)], "job int, sample int, batch int, raw string")


def verdict(claim, score, lines=(), cited=(), **more):
    return {"claimId": claim, "score": score, "lineIds": list(lines), "cited": list(cited), **more}


def test_of_several_verdicts_the_last_holds(spark):
    raw = json.dumps({"verdicts": [verdict("P1", "3"), verdict("P2", 9), verdict("P1", "12", reason="late"), {"claimId": "Q", "i": "4", "score": "x"}, {"claimId": "Q", "score": 1}]})
    v, problems = V.parse_verdicts(replies(spark, raw, "{", '{"verdicts": null}'), ["job", "sample"])
    assert sorted((r.sample, r.claim_index, r.score, tuple(r.flags), r.reason) for r in v.collect()) == [(0, 0, 10, ("score_out_of_range",), "late"), (0, 1, 9, (), ""), (0, 3, 0, ("claim_id_unknown", "score_not_int"), "")]
    assert sorted((r.sample, r.problem) for r in problems.collect()) == [(0, "bad_index"), (1, "json_parse_failed"), (2, "json_parse_failed")]


def test_findings_are_voted_cut_and_cite_chunks(spark):
    claims = spark.createDataFrame([(1, 1, [5, 6]), (1, 2, [7]), (1, 3, [])], "job int, n int, lines array<int>")
    sources = spark.createDataFrame([(1, "F1", "c3", 2, 0), (1, "F1", "c1", 1, 0), (1, "C9", "c9", 4, 1), (2, "C9", "other", 4, 1)], "job int, alias string, chunk_id string, chapter int, idx int")
    samples = [json.dumps({"verdicts": [verdict("P1", a, [6], ["C9", "F1", "zz"]), verdict("P2", b, [99]), verdict("P3", c)]}) for a, b, c in ((8, 2, 9), (6, 9, 9), (9, 7, 1))]
    got = sorted(map(tuple, V.findings(claims, replies(spark, *samples), sources).select("claim_id", "score", "lines", "chunks").collect()))
    assert got == [("P1", 8, [6], ["c9", "c1", "c3"]), ("P2", 7, [7], None), ("P3", 9, [], None)]


def test_entities_with_relations_and_the_facts_next_to_them(spark):
    entities = spark.createDataFrame([("a", "Ara", ["A", "Arra"]), ("b", "Bo", None)], "node_id string, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "Arra"), (2, "Bo"), (3, "nobody")], "query_id int, asked string")
    above = spark.createDataFrame([("a", "guild"), ("guild", "city")], "src string, dst string")
    own = spark.createDataFrame([("a", "Bo"), ("a", "Bo")], "node_id string, name string")
    other = spark.createDataFrame([("a", "Bo"), ("a", "Cy"), ("b", "Ara")], "node_id string, name string")
    got = {r.query_id: r for r in Q.entity_search(asked, entities, above, own, other).collect()}
    assert set(got) == {1, 2} and got[1].parents == ["city", "guild"] and got[1].related == ["Bo", "Cy"] and got[2].parents is None and got[2].related == ["Ara"]
    edges = spark.createDataFrame([("a", "f1"), ("f2", "a"), ("a", "f3"), ("a", "b")], "src string, dst string")
    facts = spark.createDataFrame([("f1", None, None, "x"), ("f2", 3, 3.5, "y"), ("f3", 9, None, "z")], "node_id string, chapter int, story_order double, name string")
    established = spark.createDataFrame([("f1", 5)], "node_id string, chapter int")
    evidence = spark.createDataFrame([("f1", 2, "c1"), ("f2", 1, "c2")], "node_id string, chapter int, chunk_id string")
    people = spark.createDataFrame([("f2", "Bo"), ("f2", "Ara")], "node_id string, name string")
    met = spark.createDataFrame([(1, "a")], "query_id int, node_id string")
    near = lambda **k: [(r["rank"], r.node_id, r.est_chapter, r.people) for r in Q.entity_facts(met, edges, facts, established, evidence, people, **k).orderBy("rank").collect()]
    assert near() == [(1, "f2", 3, ["Ara", "Bo"]), (2, "f1", 5, None), (3, "f3", 9, None)]
    assert near(up_to=5, most=1) == [(1, "f2", 3, ["Ara", "Bo"])] and len(near(up_to=5)) == 2


def test_claims_find_each_text_once_and_nothing_of_their_future(spark):
    nodes = lambda at: spark.createDataFrame([(at + i, f"tower gate {i}" if i % 2 else "tower  gate same", [1.0, float(i)], i) for i in range(6)], "node_id long, text string, vec array<double>, chapter int")
    calls = spark.createDataFrame([(1, 0, "hybrid_search", "tower", [1.0, 0.0], 4), (1, 1, "fact_search", "gate", [1.0, 0.0], 4), (2, 0, "fact_search", "gate", None, 1)], "claim_id long, channel int, tool string, text string, vec array<double>, up_to int")
    got = Q.claim_retrieve(calls, nodes(0), nodes(100), 3).collect()
    assert {r.node_id for r in got if r.claim_id == 1 and r.channel == 0} <= set(range(4)) and {r.node_id for r in got if r.claim_id == 2} == {100}
    same = [r for r in got if r.claim_id == 1 and r.node_id % 100 % 2 == 0]
    assert len(same) >= 2 and sum(r.has_text for r in same) == 1
    odd = [(r.node_id % 100, r.has_text) for r in got if r.claim_id == 1 and r.node_id % 2]
    assert odd and all(sum(h for m, h in odd if m == n) == 1 for n, _ in odd)
    assert got[0].asDict().keys() == {"claim_id", "channel", "node_id", "rank", "has_text"}
