"""What stages of the pipeline exchange and leave behind."""

from __future__ import annotations

import collections

from storyloom.llm import copies, mixing
from storyloom.sources import tables


def rows(spark):
    texts = [" ".join(f"w{(i * 7 + k) % (40 + i)}" for k in range(i % 9 + 1)) for i in range(60)]
    some = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    some += [(5, texts[5], "de", "s2")] * 3 + [(None, texts[8], "en", "s1"), (None, None, "en", None), (None, None, "ko", None), (0, "", "en", ""), (7, "w1 w2", "en", ""), (7, "w2 w1", "en", "")]
    return spark.createDataFrame(some, "doc_id long, text string, lang string, source string")


def test_texts_are_mixed_as_planned_and_exchanged_once(spark):
    d = rows(spark)
    plan = collections.Counter()
    for r in mixing.mix(d, block=16).collect():
        plan[r.doc_id, r.source, r.text_hash] += r.copies
    got = mixing.mixed(d, block=16)
    hashed = got.selectExpr("doc_id", "source", "xxhash64(text) AS h").collect()
    assert collections.Counter((r.doc_id, r.source, r.h) for r in hashed) == +plan and len(hashed) > 60
    same = [r for r in got.collect() if r.doc_id == 5 and r.lang == "de"]
    assert len(same) >= 3  # three rows that agree in all: each as often as the others, but for one
    initial = mixing.mixed(d, block=16)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in initial.splitlines()) <= 2  # the texts, and the plan


def test_stages_leave_what_their_result_reads(spark, tmp_path, monkeypatch):
    from storyloom.llm import common

    for m in (tables, common):
        monkeypatch.setattr(m, "shared_dir", lambda spark: f"file://{tmp_path}")
    left = lambda: sorted(p.name.split("-", 1)[1] for p in (tmp_path / "storyloom").iterdir())
    d = rows(spark)
    assert copies.drop_near_copies(d).count() > 0 and left() == ["stay"]
    assert mixing.mixed(d).count() > 0 and left() == ["plan", "stay"]
