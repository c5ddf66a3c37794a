"""Queries on small tables with odd rows against their SQL; what joins, streams and bundles may hold."""

from __future__ import annotations

import datetime
import time

import devcheck


def as_sql(spark, query, folder):
    """The rows of a query over the tables of a folder, and those of its SQL."""
    import duckdb

    from storyloom.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')")
    got, want = QUERIES[query](spark, f"file://{folder}").toPandas(), con.execute(ORACLES[query]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return devcheck.canon(got), devcheck.canon(want)


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{name}.parquet")


def test_a_character_without_states_has_null_in_the_roster(spark, tmp_path):
    import storyloom.bindings  # noqa: F401

    day = datetime.datetime(1992, 5, 1)
    table(spark, tmp_path, "customer", [(1, "a", "x"), (2, "b", "x"), (3, "b", "x"), (4, "c", None), (5, None, "y")], "c_custkey long, c_name string, c_mktsegment string")
    table(spark, tmp_path, "orders", [(1, 1, "O", day), (2, 3, "F", day), (4, 4, None, day), (None, 5, "F", datetime.datetime(1998, 1, 1)), (7, None, "F", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp")
    table(spark, tmp_path, "lineitem", [(1, 5, 1), (1, 5, 1), (1, None, 1), (2, 6, 2)], "l_orderkey long, l_partkey long, l_linenumber int")
    got, want = as_sql(spark, "prior_state_roster", tmp_path)
    assert got == want and len(got) == 3


def test_the_bound_of_likeness_holds():
    import random

    from storyloom.functions import ratios

    rng = random.Random(5)
    for letters, most in (("abcd가나  ", 12), ("ab\t c", 9), ("abcdefgh", 14), ("abc", 40)):
        x, y = (["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(4000)] for _ in "xy")
        y[:2000] = [a[: rng.randint(0, len(a))] + rng.choice(letters) + a[rng.randint(0, len(a)) :] for a in x[:2000]]
        assert (ratios.likeness(x, y) <= ratios.most_alike(x, y) + 1e-12).all()


def test_alike_names_of_one_word_meet_by_rare_marks(spark, monkeypatch):
    """The same pairs as all with all, old names never with each other; few pairs reach the likeness, and in many tasks."""
    import random
    from itertools import combinations

    from storyloom.functions import ratios
    from storyloom.operators import resolution as R

    rng = random.Random(8)
    names = {"".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 15))) for _ in range(250)}
    for n in sorted(names):
        i, j = sorted(rng.randint(0, len(n)) for _ in "ij")
        names |= {n[:i] + rng.choice("aeiouxyz") + n[i:], n[:i] + n[i + 1 :], n[:j] + "q" + n[j + 1 :], n[i:j], f"x{n}yz{n[:3]}", f"{n[:i]} {n[i:]}".strip()} if rng.random() < 0.3 else set()
    names = sorted(names - {""})
    fresh = set(rng.sample(names, len(names) // 2))
    rows = [("t", "Character", n) for n in names]
    table = lambda some: spark.createDataFrame(some, "tenant string, label string, k string")
    got = R.alike_pairs(table([r for r in rows if r[2] in fresh]), table(rows))
    pairs = [(a, b) for a, b in combinations(names, 2) if a in fresh or b in fresh]
    like = ratios.likeness(*map(list, zip(*pairs, strict=True)))
    assert sorted((r.x, r.y) for r in got.collect()) == sorted(p for p, v in zip(pairs, like, strict=True) if v >= 0.85)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_matches_of_names_are_not_exchanged(spark):
    """Pairs are many times both tables where names are common; requests and nodes of several names give each pair once."""
    from storyloom.operators import joins as J

    nodes = [(i, ["ann", "bob", None][i % 3], [["ann", "cy"], [], None, ["bob", "ann"]][i % 4]) for i in range(60)] + [(0, "cy", ["dee"])]
    asked = [(1, "ann"), (1, "bob"), (1, "ann"), (2, "cy"), (2, "dee"), (3, None), (4, "eve"), (5, "bob")]
    e, q = spark.createDataFrame(nodes, "node_id long, name string, aliases array<string>"), spark.createDataFrame(asked, "query_id long, asked string")
    got = J.entity_match(q, e)
    want = {(i, n) for i, a in asked if a for n, name, aliases in nodes if a == name or a in (aliases or [])}
    assert sorted((r.query_id, r.node_id) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(query_id" not in plan.split("Join")[0]


def test_a_subgraph_goes_through_in_slices(spark, tmp_path, monkeypatch):
    """Eight slices give what one gives, and leave the edges of each and nothing of their members."""
    import os

    import pytest

    from storyloom.bindings import graphs
    from storyloom.sources import tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are absent")
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = lambda: sorted(map(tuple, graphs.subgraph_rows(spark, "/root/testdata/sf0.001").collect()))
    want = rows()
    monkeypatch.setattr(graphs, "SLICE", 500)
    assert rows() == want and want
    names = [p.name.split("-", 1)[1] for p in (tmp_path / "storyloom").iterdir()]
    assert names.count("subgraph") == 9 and not {"members", "hot"} & set(names)


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path, monkeypatch):
    from storyloom.sources import tables

    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    before = spark.conf.get(tables.CLEANUP, "false")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(not b.name().startswith("broadcast") for b in (blocks.getAllBlocks().apply(i) for i in range(blocks.getAllBlocks().size())))
    n, made = held(), [tables.kept(spark.range(5000).repartition(7, "id").groupBy("id").count(), "x") for _ in range(3)]
    until = time.time() + 20  # Spark doesn't wait for it
    while held() > n and time.time() < until:
        time.sleep(0.2)
    assert held() <= n and spark.conf.get(tables.CLEANUP, "false") == before
    assert [df.count() for df in made] == [5000] * 3


def test_scores_of_requests_and_documents_are_not_exchanged(spark, monkeypatch):
    """The best by brute force, in blocks of requests and few pairs at a time; a document in two rows is one."""
    import math
    import random
    from collections import Counter

    from storyloom.operators import search as S

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(0, 30))), rng.choice([None, 1, 4])) for i in range(150)]
    docs += [(200, "w1 w2", 1), (200, "w2 w39", 1), (201, None, 1), (202, "", None), *[(300 + i, "w7 w0", 2) for i in range(9)]]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, 2, 3])) for i in range(25)] + [(90, "w7", None), (91, "none", 5), (92, None, 1)]
    rows = {}
    for i, text, chapter in docs:
        rows.setdefault(i, (Counter(), chapter))[0].update((text or "").split())
    rows = {i: r for i, r in rows.items() if r[0]}
    avg, want = sum(sum(c.values()) for c, _ in rows.values()) / len(rows), []
    for q, text, up_to in asked:
        hits = []
        for i, (c, chapter) in rows.items():
            own = [w for w in set((text or "").split()) if c[w]]
            if own and (up_to is None or chapter is None or chapter < up_to):
                df = {w: sum(w in o for o, _ in rows.values()) for w in own}
                s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in own)
                hits.append((-round(s, 6), i))
        want += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(hits)[:4])]
    d, r = spark.createDataFrame(docs, "node_id long, text string, chapter int").repartition(3), spark.createDataFrame(asked, "query_id long, text string, up_to int")
    for block, pairs in ((1 << 20, 1 << 20), (15, 60)):
        monkeypatch.setattr(S, "BROADCAST_ROWS", block)
        monkeypatch.setattr(S, "PAIRS", pairs)
        hits = S.fulltext_topk(r, d, 4)
        got = sorted((x.query_id, x.node_id, x["rank"], x.score) for x in hits.collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want), strict=True))
        plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "Exchange hashpartitioning(query_id" in plan and "hashpartitioning(query_id#0L, node_id" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_postings_are_dealt_and_searched_in_slices(spark, tmp_path, monkeypatch):
    """Slices of words and of nodes give what one gives; a bundle that failed halfway is replaced whole."""
    import os
    import random

    from storyloom.operators import postings as P

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.randint(0, 25)))) for i in range(300)], "node_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w30"), (3, "none"), (4, " ".join(f"w{k}" for k in range(50)))], "query_id long, text string")
    found, files = [], lambda path: sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)
    for n, size in enumerate((1 << 40, 40)):
        monkeypatch.setattr(P, "SLICE", size, raising=False)
        index = P.Postings(spark, f"file://{tmp_path}/{n}", parts=4)
        docs.limit(7).write.mode("overwrite").parquet(f"file://{tmp_path}/{n}/blocks/bundle=1/part=0")  # of a bundle without totals
        for i in range(2):
            index.add(docs.where(f"node_id % 2 = {i}"))
        found.append(sorted(tuple(r) for r in index.search(asked, 5).collect()))
        assert index.read("blocks").agg({"n": "sum"}).first()[0] == index.read("terms").agg({"n": "sum"}).first()[0]
    assert found[0] == found[1] and len(found[0]) == 15
    slices = []
    monkeypatch.setattr(P, "kept", lambda df, name, *a, _kept=P.kept, **k: (slices.append(name), _kept(df, name, *a, **k))[1])
    index.search(asked, 5)
    assert slices.count("best") == P.SLICES


def test_a_models_waiting_calls_are_read_span_by_span():
    """The same balances as step by step, over batches and watermarks; no more calls at once than a span or a buffer has."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from storyloom.streaming import jobs as K

    class Cell:
        def __init__(self):
            self.value = None

        exists, get, update = lambda s: s.value is not None, lambda s: s.value, lambda s, v: setattr(s, "value", v)

    class Cells(dict):
        most = 0
        containsKey, keys, removeKey = lambda s, k: k in s, lambda s: iter(list(dict.keys(s))), lambda s, k: s.pop(k)  # noqa: N815

        def getValue(self, k):  # noqa: N802
            Cells.most = max(Cells.most, len(self[k][0]) // K.Quota.CALL.itemsize)
            return self[k]

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

    rng = random.Random(7)
    calls = [(rng.randrange(20 * 3600_000), i, rng.random() < 0.05, rng.randrange(37), rng.randrange(7) * 3600_000) for i in range(3000)]
    calls.sort(key=lambda c: c[0] // (5 * 3600_000) + rng.random())  # four batches, a little mixed
    cells = Cells()
    quota, seen, passed = K.Quota(), [], 0
    quota.BUFFER = 100
    quota.init(SimpleNamespace(getValueState=lambda *a: Cell(), getMapState=lambda *a: cells, registerTimer=lambda at: None))
    for lo in range(0, 3000, 500):
        some = calls[lo : lo + 500]
        frames = [pd.DataFrame(some[i : i + 60], columns=["at", "event_id", "observed", "tokens", "reset"]) for i in range(0, 500, 60)]
        out = next(iter(quota.handleInputRows(("m",), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed))))
        seen += some
        left, reset = 1000, 0
        for at, _, observed, tokens, wait in sorted(seen):
            if reset and at >= reset:
                left, reset = 1000, 0
            left, reset = (tokens, at + wait) if observed else (max(0, left - tokens), reset)
        assert (out["left_over"][0], out["n"][0]) == (left, len(seen))
        passed = max(0, min((c[0] for c in calls[lo + 500 :]), default=0))  # nothing earlier comes
    assert 0 < Cells.most < 400 and len(cells) < 20
