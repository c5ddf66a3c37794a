"""Likeness of names, resolution and the build of a graph by bundles, against brute force and against one whole build."""

from __future__ import annotations

import json
import random
from collections import Counter
from functools import lru_cache
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from storyloom.functions import ratios
from storyloom.functions import text as X
from storyloom.operators import resolution as R
from storyloom.operators.indexing import Graph


@lru_cache(None)
def common(x, y):
    rows = [[0] * (len(y) + 1)]
    for c in x:
        rows.append([0])
        for j, d in enumerate(y):
            rows[-1].append(rows[-2][j] + 1 if c == d else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def whole(x, y):
    return 2 * common(x, y) / (len(x) + len(y)) if x or y else 1.0


def part(x, y):
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 0.0 if y else 1.0
    best = max(whole(x, y[i:j]) for i in range(len(y)) for j in range(i + 1, len(y) + 1) if j - i == len(x) or (j - i < len(x) and (i == 0 or j == len(y))))
    if len(x) == len(y):
        best = max(best, max(whole(y, x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if i == 0 or j == len(x)))
    return best


def by_hand(x, y):
    """The published blend of ratios, pair by pair."""
    if not x or not y:
        return 0.0
    longer = max(len(x), len(y)) / min(len(x), len(y))
    p, q = sorted(x.split()), sorted(y.split())
    shared, one, two = sorted(set(p) & set(q)), sorted(set(p) - set(q)), sorted(set(q) - set(p))
    joined = lambda *parts: " ".join(w for part_ in parts for w in part_)
    if longer < 1.5:
        sets = 0.0
        if p and q:
            sets = 1.0 if shared and not (one and two) else max(sets_of(shared, one, two))
        return max(whole(x, y), 0.95 * max(whole(joined(p), joined(q)), sets))
    tokens = 1.0 if shared else max(part(joined(p), joined(q)), part(joined(sorted(set(p))), joined(sorted(set(q)))))
    scale = 0.9 if longer <= 8 else 0.6
    return max(whole(x, y), scale * part(x, y), 0.95 * scale * tokens)


def sets_of(shared, one, two):
    s, a, b = (" ".join(v) for v in (shared, one, two))
    gap = " " if s else ""
    # The shared words stand before the others on both sides and match as they are.
    yield 2 * (len(s + gap) + common(a, b)) / (2 * len(s + gap) + len(a) + len(b)) if s or a or b else 1.0
    if s:
        yield 2 * len(s) / (2 * len(s) + 1 + len(a))
        yield 2 * len(s) / (2 * len(s) + 1 + len(b))


def some_names(rng, n, letters="abcd가나", most=12):
    return ["".join(rng.choice(letters + "  ") for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_likeness_of_a_batch_equals_pair_by_pair():
    rng = random.Random(11)
    x, y = some_names(rng, 5000), some_names(rng, 5000)
    x += ["kim dokja", "dokja kim", "dokja", "", "독자", "김 독자", "a" * 70 + "b", "ab" * 50, "a b a b", "   ", "x"]
    y += ["kim dokja", "kim dokja", "kim dokja the reader", "a", "김독자", "김독자 씨", "a" * 66 + "cb", "ba" * 45, "a b", "a", "x" * 9]
    got = ratios.likeness(x, y)
    for a, b, g in zip(x, y, got, strict=True):
        assert g == pytest.approx(by_hand(a, b), abs=1e-12), (a, b)


def test_likeness_column_keeps_nulls(spark):
    rows = spark.createDataFrame([("kim", "kim"), (None, "a"), ("a", None)], "a string, b string")
    assert [r.w for r in rows.select(ratios.wratio("a", "b").alias("w")).collect()] == [1.0, None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_alike_pairs_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = sorted({n.strip() for n in some_names(rng, 160, "abcde", 9)} - {""}) + ["독", "독자", "김 독자", "김독자"]
    rows = [(f"t{i % 2}", "Character", n) for i, n in enumerate(names)]
    got = R.alike_pairs(*[spark.createDataFrame(rows, "tenant string, label string, k string")] * 2)
    want = {(t, *sorted((x, y))) for (t, _, x), (u, _, y) in combinations(rows, 2) if t == u and by_hand(x, y) >= 0.85}
    assert {(r.tenant, *sorted((r.x, r.y))) for r in got.collect()} == want and len(want) > 20


def story(rng, tenants=3, chapters=9):
    """(chapters, extractions, summaries): names in several spellings, evidence, and what no graph may hold."""
    people = ["Kim Dokja", "Dokja Kim", "Kim Dokjaa", "Han Sooyoung", "Han Sooyoungg", "Yoo Joonghyuk", "독자", "김독자", "상아", "Lee"]
    places = ["<Tower Gate>", "Tower Gate", "TowerGate", "Car 3807", "Car 3907", "[Car 3907]"]
    texts, made, said = [], [], []
    for t in range(tenants):
        for c in range(1, chapters + 1):
            tenant = f"{t}:1"
            who = rng.sample(people, 3)
            nodes = [{"id": f"p{i}", "label": "Character", "properties": {"name": n, "description": f"{n} {rng.randint(0, 3)}", "aliases": f"{n[:2]}, x{i}"}} for i, n in enumerate(who)]
            nodes += [{"id": "l", "label": "Location", "properties": {"name": rng.choice(places), "height": "9"}}, {"id": "l2", "label": "Location", "properties": {"name": rng.choice(places)}}]
            nodes += [{"id": "e", "label": "Event", "properties": {"name": "fight", "chapter": str(c), "story_order": str(c + 0.1), "evidence_chunk": "C0, C1,x"}}, {"id": "s", "label": "CharacterState", "properties": {"name": "fight", "evidence_chunk": "C0001"}}]
            nodes += [{"id": "?", "label": "Mood", "properties": {"name": "x"}}, {"id": "n", "label": "Item", "properties": {"height": "1"}}]
            rel = [("p0", "APPEARS_IN", "e"), ("p1", "APPEARS_IN", "e"), ("l", "HOSTS", "e"), ("p0", "HAS_STATE", "s"), ("s", "ESTABLISHED_IN", "e"), ("l", "LOCATED_IN", "l2"), ("l", "APPEARS_IN", "e"), ("p2", "APPEARS_IN", "nowhere")]
            made.append((tenant, c, json.dumps({"nodes": nodes, "relationships": [{"type": k, "start_node_id": a, "end_node_id": b} for a, k, b in rel]}) if (t, c) != (1, 4) else "{broken"))
            texts.append((tenant, c, f"Chapter {c} begins here. " * 12))
            said.append((tenant, c, f"summary {c}"))
    return texts, made, said


def frames(spark, parts, keep):
    schemas = ("tenant string, chapter int, text string", "tenant string, chapter int, raw string", "tenant string, chapter int, summary string")
    return [spark.createDataFrame([r for r in rows if keep(r)], s) for rows, s in zip(parts, schemas, strict=True)]


VIEWS = {
    "entities": lambda g: g.entities(),
    "edges": lambda g: g.edges(),
    "facts": lambda g: g.facts(),
    "canonical": lambda g: g.canonical().drop("bundle"),
    "names": lambda g: g.names(),
    "stories": lambda g: g.stories(),
    **{n: (lambda g, n=n: g.read(n).drop("bundle")) for n in ("chunks", "evidence", "summaries", "pruned", "markers")},
}


def rows_of(df):
    return Counter(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """One graph built at once, and one in four bundles out of order, of which the last has all chapters again."""
    parts, at = story(random.Random(3)), tmp_path_factory.mktemp("graph")
    one, many = Graph(spark, f"file://{at}/one"), Graph(spark, f"file://{at}/many")
    one.add(*frames(spark, parts, lambda r: True))
    for keep in (lambda r: r[1] in (4, 5), lambda r: r[1] <= 3 and r[0] != "2:1", lambda r: r[1] in (3, 8), lambda r: True):
        many.add(*frames(spark, parts, keep))
    return one, many


@pytest.mark.parametrize("view", VIEWS)
def test_bundles_give_what_one_build_gives(built, view):
    one, many = (rows_of(VIEWS[view](g)) for g in built)
    assert one == many and one


def test_what_is_merged_follows_the_label(built):
    one, _ = built
    names = {(r.tenant, r.label): set() for r in one.entities().collect()}
    for r in one.entities().collect():
        names[r.tenant, r.label].add(r.node_id)
    nodes = one.canonical().collect()
    for tenant in ("0:1", "1:1", "2:1"):
        own = {r.name: r.canonical for r in nodes if r.tenant == tenant and r.label == "Location"}
        groups = {n: own.get(n) for n in ("<Tower Gate>", "Tower Gate", "TowerGate") if n in own}
        assert len(set(groups.values())) <= 1 and own.get("Car 3807") != own.get("Car 3907")
        who = {r.name: r.canonical for r in nodes if r.tenant == tenant and r.label == "Character"}
        assert len({who[n] for n in ("Kim Dokja", "Dokja Kim", "Kim Dokjaa") if n in who}) == 1
        assert len({who[n] for n in ("Kim Dokja", "Han Sooyoung", "Yoo Joonghyuk", "상아", "Lee") if n in who}) == sum(n in who for n in ("Kim Dokja", "Han Sooyoung", "Yoo Joonghyuk", "상아", "Lee"))
    assert all(r.canonical == r.node_id for r in nodes if r.label in ("Event", "CharacterState"))
    # Equal names of two tenants stay two things.
    assert len({r.tenant for r in nodes}) == 3 and not any(len({r.tenant for r in nodes if r.canonical == c}) > 1 for c in {r.canonical for r in nodes})


def test_what_no_graph_may_hold_is_counted(built):
    n = Counter()
    for r in built[0].read("pruned").collect():
        n[r.reason] += r.n
    assert n == {"label": 26, "no_property": 26, "property": 26, "pattern": 26, "dangling": 26, "no_json": 1}


def test_evidence_and_chapters_of_facts(built):
    one, _ = built
    facts = {(r.tenant, r.label, r.est_chapter) for r in one.facts().collect()}
    assert ("0:1", "CharacterState", 7) in facts and ("0:1", "Event", 7) in facts
    chunks = {r.chunk_id for r in one.read("chunks").collect()}
    assert all(r.chunk_id in chunks for r in one.read("evidence").collect()) and one.read("evidence").count() == 26 * 3


def test_a_bundle_writes_names_of_the_sets_that_it_touches_only(spark, tmp_path):
    g = Graph(spark, f"file://{tmp_path}/g")

    def add(chapter, *names):
        nodes = [{"id": str(i), "label": "Character", "properties": {"name": n}} for i, n in enumerate(names)]
        row = [("a", chapter, json.dumps({"nodes": nodes, "relationships": []}))]
        return g.add(spark.createDataFrame([("a", chapter, "Text.")], "tenant string, chapter int, text string"), spark.createDataFrame(row, "tenant string, chapter int, raw string"))

    add(1, "Kim Dokja", "Yoo Joonghyuk", "Lee Hyunsung", "Shin Yoosung")
    add(2, "Dokja Kim")
    assert {r.k for r in g.read("names").where("bundle = 2").collect()} == {"Kim Dokja", "Dokja Kim"}
    add(3, "Jung Heewon")
    assert {r.k for r in g.read("names").where("bundle = 3").collect()} == {"Jung Heewon"}
    assert g.names().select("canonical").distinct().count() == 5
    # A new name that two sets are like makes them one.
    add(4, "Lee Hyunsung Shin Yoosung")
    assert {r.k for r in g.read("names").where("bundle = 4").collect()} == {"Lee Hyunsung", "Shin Yoosung", "Lee Hyunsung Shin Yoosung"}
    assert g.names().select("canonical").distinct().count() == 4


def test_a_bundle_without_markers_is_not_seen_and_is_replaced(spark, tmp_path):
    parts, g = story(random.Random(5), 1, 3), Graph(spark, f"file://{tmp_path}/g")
    g.add(*frames(spark, parts, lambda r: r[1] == 1))
    before = {v: rows_of(f(g)) for v, f in VIEWS.items()}
    write, g._write = g._write, lambda df, name, bundle: write(df, name, bundle) if name != "pruned" else 1 / 0
    with pytest.raises(ZeroDivisionError):
        g.add(*frames(spark, parts, lambda r: r[1] == 2))
    g._write = write
    assert {v: rows_of(f(g)) for v, f in VIEWS.items()} == before
    for _ in range(2):
        g.add(*frames(spark, parts, lambda r: True))
    whole_ = Graph(spark, f"file://{tmp_path}/h")
    whole_.add(*frames(spark, parts, lambda r: True))
    assert all(rows_of(f(g)) == rows_of(f(whole_)) for f in VIEWS.values())


def test_tenants_of_a_request_prune_partitions(built, spark):
    from storyloom.operators.joins import in_scope

    asked = spark.createDataFrame([("0:1", 3), ("9:9", 1)], "tenant string, rank int").where("rank > 2")
    rows = in_scope(built[1].read("nodes"), asked, "tenant")
    assert "dynamicpruning" in rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {r.tenant for r in rows.select("tenant").distinct().collect()} == {"0:1"}


def test_spans_of_a_very_long_text_take_one_pass(spark):
    text = "Some words, and some more. " * 200_000
    d = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    sizes = [sorted(r[0] or 0 for r in d.select(F.size(c)).collect())[-1] for c in (X.sentence_spans(X.sentences(F.col("text"))), X.chunk_spans(F.col("text"), F.lit(100)), X.pack_pieces(F.col("text")))]
    assert sizes == [200_000, 66_667, 200_000]
    assert len(X.packed(X.places(["Some words, and some more. "] * 200_000), 100)) == 66_667
