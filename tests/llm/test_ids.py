"""Several texts without id, and one id with several texts, in the dedups of repeated windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from test_llm import brute_bytes, table

from storyloom.llm import recompress, repeats, suffixes


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    one, two = words(rng, 60), words(rng, 60)
    texts = [(None, [*one, *words(rng, 30)]), (None, [*one, *words(rng, 10)]), (None, words(rng, 45)), (None, words(rng, 3)), (None, []), (7, [*words(rng, 50), *two]), (7, [*words(rng, 50), *two]), (7, words(rng, 40)), (7, words(rng, 2)), (8, two)]
    return [(i, " ".join(t)) for i, t in texts]


def test_words_of_each_text_alone(spark, rows):
    t = table(spark, [(i, x, "en", "s") for i, x in rows])
    got = recompress.dedup_words(t).collect()
    th = {r.text: r.th for r in repeats.base_of(t).collect()}
    first, want = {}, []
    places = sorted(((i is None, i or 0, th[x]), x) for i, x in rows)
    for place, x in places:
        w = x.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (place, k))
    for place, x in places:
        w = x.split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (place, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(y for y, g in zip(w, gone, strict=True) if not g)
        want.append((None if place[0] else place[1], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert sum(r.n_removed for r in got) == 180


def test_bytes_of_each_text_alone(spark, rows):
    got = suffixes.dedup_bytes(table(spark, [(i, x, "en", "s") for i, x in rows])).collect()
    want = brute_bytes([(k, x.encode()) for k, (_, x) in enumerate(rows)], 200)
    assert Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((rows[k][0], *v) for k, v in want.items())
