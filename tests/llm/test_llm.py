"""The operators of the llm package against brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from storyloom.llm import common, language, lines, media, mixing, pieces, quality, recompress, simhash, suffixes, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, component_id long"


def table(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "x", 7) for i, t, lang, s in rows], DOCS)


def odd_rows():
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(6000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, "same text here again and again", "en", "a"), (4, "same text here again and again", "en", "a"), (4, "same text here again and again", "en", "a"), (None, "a row without id", None, "b"), (5, long_, "en", "b"), (6, " \n\t ", "en", "b"), (7, "한국어 text é　ü", "de", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def shared(rng, n=40, vocabulary=30):
    """Texts that share passages, with runs of one word."""
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) + str(rng.randint(0, vocabulary)) for _ in range(60)) for _ in range(6)]
    out = []
    for _ in range(n):
        x, y = rng.choice(base).split(), rng.choice(base).split()
        i, j = rng.randint(0, 60), rng.randint(0, 60)
        out.append(" ".join(x[:i] + ["z"] * rng.choice([0, 0, 30]) + y[j:]))
    return out


# ---- line 2: recompression


def brute_words(rows, window):
    first = {}
    for i, t in sorted(rows):
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recompression_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(shared(rng)))
    got = recompress.dedup_words(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 20)


def test_recompression_odd_rows(docs, none):
    got = recompress.dedup_words(docs).collect()
    assert len(got) == docs.count() and recompress.dedup_words(none).count() == 0
    assert {r.n_words for r in got if r.doc_id in (1, 2, 6)} == {0}
    assert all(r.n_removed == 0 for r in got)  # the copies are shorter than a window


def test_names_of_equal_passages_agree():
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"q{rng.random()}" for _ in range(k)] + passage) for k in (3, 8)]
    a = recompress.anchors([1, 2], texts)
    twice = Counter(a["h"].tolist())
    assert sum(n > 1 for n in twice.values()) >= 3


# ---- 8: suffixes


def brute_bytes(rows, window):
    c = Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    out = {}
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if c[t[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out[i] = (sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_suffixes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = shared(rng, 25) + ["é" * 300, "ab" * 200]
    got = suffixes.dedup_bytes(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes([(i, t.encode()) for i, t in enumerate(texts)], 200)


def test_suffix_columns_small_windows():
    rng = random.Random(6)
    for _ in range(30):
        texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 90))) for _ in range(8)]
        c = suffixes.anchors(list(range(8)), texts, 20, 6, at_once=rng.choice([40, 1000]))
        content = [texts[t][p - a : p - b + 20].encode() for t, p, a, b in zip(c["th"], c["pos"], c["a"], c["b"])]
        got = set()
        if content:
            for who, d in suffixes.repeated_windows(b"".join(content), c["a"].astype(np.int64), c["b"].astype(np.int64), 20):
                got |= {(int(c["th"][w]), int(c["pos"][w]) - d) for w in who}
        count = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
        assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 19) if count[t[i : i + 20]] > 1}


def test_suffixes_odd_rows(docs, none):
    got = suffixes.dedup_bytes(docs).collect()
    assert len(got) == docs.count() and suffixes.dedup_bytes(none).count() == 0
    assert {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}


# ---- 3: pieces


@pytest.fixture(scope="module")
def codecs():
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return pieces.PieceCodec(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(codecs):
    own, library = codecs
    rng = random.Random(7)
    letters = " ▁aeithnos.\n\t\0\x01日本é한국ö<s></s>0123 ⁇　﻿😀́—ꀀ"
    texts = ["", " ", "  ", "▁", "\n", " " * 15, " " * 33 + "x", "x  y   z"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + shared(rng, 5)
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids), t


def test_pieces_of_a_table(spark, docs, none, codecs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode_documents(docs, path).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == docs.count() and pieces.encode_documents(none, path).count() == 0
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (1, 2))
    by = {r.doc_id: r for r in got}
    text = odd_rows()[6][1]
    ids = codecs[1].encode(text)
    assert by[5].n_tokens == len(ids) and by[5].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pieces_leave_a_worker_no_cache(spark, docs):
    """Workers go on to other stages: what a task kept between texts must not stay in their memory."""

    def held(batches):
        for b in batches:
            kept = sum(len(c.cache) + len(c.valid) for c in pieces._codecs.values())
            yield pa.RecordBatch.from_pylist([{"codecs": len(pieces._codecs), "kept": kept}])

    assert pieces.encode_documents(docs.coalesce(1), public_tokenizers.path("piece_bpe_32k.model")).count() == docs.count()
    seen = spark.range(0, 64, 1, 64).mapInArrow(held, "codecs long, kept long").collect()
    assert max(r.codecs for r in seen) == 1 and max(r.kept for r in seen) == 0


def test_pieces_of_many_segments(codecs):
    """A cache that is emptied between texts and inside a long one, and segments that don't decode to themselves."""
    own, library = codecs
    rng = random.Random(8)
    texts = ["\ud800 a\udfff b", *(" ".join(rng.choice(["aé", "\x01", "\u2581x", "日本", "of the"]) + str(rng.randrange(3000)) for _ in range(n)) for n in (70_000, 5, 66_000))]
    own.limit, limit = 4_000, own.limit
    try:
        for t in texts:
            ids = own.encode(t) if "\ud800" in t else library.encode(t)
            want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
            assert own.digest(t) == want
            if "\ud800" not in t:
                assert own.decode(ids) == library.decode(ids)
    finally:
        own.limit = limit


# ---- 4: lines


def test_lines_keep_the_first_chunk(spark):
    block = "\n".join(f"shared line {i}" for i in range(80))
    rows = [(i, f"own {i}\nmore {i}\n{block}\nend {i}", "en", "s") for i in range(5)]
    out = {r.doc_id: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert out[0]["__n_removed"] == 0 and out[0].text == rows[0][1]
    for i in range(1, 5):
        assert out[i]["__n_removed"] >= 40 and f"own {i}" in out[i].text and f"end {i}" in out[i].text


def test_lines_odd_rows(docs, none):
    out = lines.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count() and lines.dedup_lines(none).count() == 0
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] is None and by[2] == "" and by[5] == odd_rows()[6][1]


def test_lines_plan_has_no_python(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- 7: SimHash


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


@pytest.mark.parametrize("pairwise", [128, 1])
def test_simhash_matches_brute_force(spark, pairwise):
    rng = random.Random(8)
    texts = shared(rng, 30) + ["", None, "one two", "ONE two"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    for b in range(40):  # fingerprints near to each other
        rows.append((100 + b, texts[0] + " tail" * (b % 4), "en", "s"))
    fp = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = simhash.near_duplicates(table(spark, rows), pairwise=pairwise).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_simhash_odd_rows(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]


# ---- 5: vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 16))
    x = np.vstack([base[rng.integers(12, size=150)] + rng.normal(size=(150, 16)) * rng.choice([0.05, 0.25], size=(150, 1)), base[:5], base[:5]])
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(len(x))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None], 1), (505, [], 1), (506, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (np.arange(len(x))[:, None] % 3 == np.arange(len(x))[None, :] % 3) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(root, np.where(link, root[None, :], 10**9).min(axis=1))
        if (low == root).all():
            break
        root = low
    want = {i: (int(link[i].sum()), int(root[i])) for i in range(len(x))} | {i: (0, i) for i in range(500, 507)}
    for options in ({}, {"cell": 10, "block": 7}):
        got = vectors.near_vectors(df, **options).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in vectors.near_vectors(df).collect() if r.n_links)
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


# ---- 6: media


def test_media_round_trip(spark, docs, none):
    got = media.media_columns(docs).collect()
    assert len(got) == docs.count() and media.media_columns(none).count() == 0
    for i, t, _, _ in odd_rows():
        raw = (t or "").encode()
        padded = raw + bytes(max(64, math.ceil(len(raw) / 64) * 64) - len(raw))
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())


def test_media_ranges_and_retries(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    d = table(spark, [(i, f"text {i} " * 50, "en", "s") for i in range(200)])
    media.store_documents(d, path)
    got = media.describe(media.read_media(spark, path, rangebytes="3000", batchbytes="500")).collect()
    assert sorted(r.doc_id for r in got) == list(range(200))
    reader = media.MediaReader({"path": path})
    calls = []

    def broken(f, info):
        calls.append(info.header_offset)
        if len(calls) < 3:
            raise OSError("lost")
        return real(f, info)

    real, reader.take = media.MediaReader.take, broken
    part = reader.partitions()[0]
    assert sum(b.num_rows for b in reader.read(part)) > 0 and len({calls[0], calls[1], calls[2]}) == 1


def test_media_wrong_bytes_are_noticed():
    png = bytearray(media.to_png(media.payload("abc"), 3))
    assert media.from_png(bytes(png)) == (media.payload("abc"), 3)
    png[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


# ---- 9: mixing


def test_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 1000)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total = 1.5 * 3100
    rest = total - 200  # a (weight 5) stops at 200; then b, c and the null source (2, 1, 5)
    assert got["a"] == 200 and got[None] == 2000
    assert abs(got["b"] - (rest - 2000) * 2 / 3) < 1e-6 and abs(got["c"] - (rest - 2000) / 3) < 1e-6


@pytest.mark.parametrize("block", [4096, 32])
def test_mix_comes_near_its_targets(spark, block):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * min(120, int(rng.paretovariate(1.2) * 5))), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    d = table(spark, rows)
    got = mixing.mix(d, block=block).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 10
    again = mixing.mix(d.repartition(3), block=block).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    assert mixing.mixed(d, block=block).count() == sum(r.copies for r in got)


def test_flight_keeps_sums_and_means():
    rng = np.random.default_rng(11)
    size, pi = rng.pareto(1.5, 60) * 10 + 1, rng.uniform(0.1, 0.9, 60)
    runs = np.array([mixing.flight(pi, size, np.random.default_rng(k)) for k in range(400)])
    assert np.abs(runs @ size - pi @ size).max() < 1e-4 * size.sum() and np.abs(runs.sum(axis=1) - pi.sum()).max() < 1e-4
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 2).all() and np.abs(runs.mean(axis=0) - pi).max() < 0.12


def test_mix_odd_rows(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(none).count() == 0
    assert all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 6))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(none).count() == 0


# ---- 1 and 10: classifiers


def test_quality_held_out(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if i % 5 == 0 else " ".join(w) + ".", "en", "s"))
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)] + [(3, None), (9999, 1)], "doc_id long, quality int")
    got = quality.classify(table(spark, rows), labels).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in got if r.doc_id >= 300) >= 97
    assert quality.accepted(table(spark, rows), labels).count() == sum(r.predicted for r in got)


def test_quality_odd_rows(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, no_labels).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, quality int")
    assert quality.classify(docs, one).count() == docs.count() and quality.classify(none, one).count() == 0
    assert quality.accepted(none, one).count() == 0


def test_isotonic_rises():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.8, 0.4, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and abs(np.interp(1.5, x, y) - 0.6) < 1e-9


def test_language_held_out(spark, docs, none):
    rng = random.Random(13)
    parts = {"en": ["th", "he", "ing", "er", "on"], "de": ["sch", "ung", "der", "ein", "ie"], "fr": ["eau", "que", "oi", "ent", "le"]}
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang, "s"))
    d = table(spark, rows)
    model = language.fit(d, rounds=6)
    got = language.label_documents(d, model).collect()
    assert all(r.lang_pred == ["en", "de", "fr"][r.doc_id % 3] for r in got if r.held_out)
    odd = {r.doc_id: r for r in language.label_documents(docs, model).collect()}
    assert {odd[i].lang_pred for i in (1, 2, 6)} == {"und"} and language.label_documents(none, model).count() == 0
    assert language.label_documents(d, language.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert (np.diag(model.move) > model.move.mean(axis=1)).all()


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(14)
    m = language.Model(["a", "b"], np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros((1, 2)), np.zeros(2))
    e = rng.normal(size=(5, 2))
    post, moves = language.forward_backward(e, np.array([2, 3]), m)
    for lo, n in ((0, 2), (2, 3)):
        total, want = 0.0, np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            p = math.exp(m.start[path[0]] + sum(e[lo + k, y] for k, y in enumerate(path)) + sum(m.move[path[k], path[k + 1]] for k in range(n - 1)))
            total += p
            for k, y in enumerate(path):
                want[k, y] += p
        assert np.allclose(post[lo : lo + n], want / total, atol=1e-5)
    assert abs(moves.sum() - 3) < 1e-4


# ---- shared


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (200, 100)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    rows = [(i, "\n".join(shared(rng, 3)), "en", f"s{i % 4}") for i in range(60)] + [(100 + i, "\n".join(["x"] * 3), "en", "s0") for i in range(3)]
    d = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert F is not None
