"""Byte-level pairs, alignment and importance resampling against the libraries, brute force and odd inputs."""

from __future__ import annotations

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyloom.llm import alignment, bytepairs, resampling

RANKS, JSON, MODEL = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, row long, pair string, score double, rank int, links int, n long"


def table(spark, rows):
    """rows of (doc_id, text), with columns whose names clash with results and with inner ones."""
    return spark.createDataFrame([(i, t, 5, "x", 0.5, 3, 4, 9) for i, t in rows], DOCS)


def wild(rng, n):
    """Texts of words in several alphabets, odd spaces, digits, marks, emoji and any code point."""
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABC", "éüßñç", "가나다라마바사", "漢字仮名交じり", "абвгд", "0123456789", "'.,;:!?-<|>", " \t\n\r  　\x1c\x85", "😀👍🏽é‍"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 30)):
            a = rng.choice(alphabets)
            parts.append("".join(rng.choice(a) for _ in range(rng.randint(1, 9))) + rng.choice(["", " ", " ", "  ", "\n"]))
            if rng.random() < 0.2:
                c = rng.randrange(1, 0x110000)
                parts.append(chr(c) if not 0xD800 <= c < 0xE000 else "x")
        out.append("".join(parts))
    return out


def odd_rows():
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(5000))
    return [(1, None), (2, ""), (3, "same text here again"), (4, "same text here again"), (4, "same text here again"), (None, "a row without id"), (5, long_), (6, " \n\t "), (7, "한국어 text é　ü ▁ here"), (8, "<|endoftext|> <s> it's <0x41>"), (9, "a" * 3000 + "é" * 700)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(wild(random.Random(3), 150), 100)) + odd_rows()


# ---- byte-level pairs


@pytest.fixture(scope="module")
def pairs():
    return bytepairs.PairCodec(bytepairs.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(RANKS), special_tokens={})


def test_pairs_equal_the_library_row_by_row(spark, rows, library):
    got = bytepairs.encode_documents(table(spark, rows), RANKS, public_tokenizers.PATTERN, ids=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    want = {i: t or "" for i, t in rows}
    for r in got:
        ids = library.encode_ordinary(want[r.doc_id])
        assert r.ids == ids, want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_every_token_but_whole_words_merges_into_itself(pairs):
    """What the query for long words relies on; tokens that no merge makes are found as whole words only and never inside one."""
    tokens = list(pairs.ranks)
    got = pairs._contracted(tokens, False)
    n = np.bincount(got["w"].to_numpy(), minlength=len(tokens))
    made = {tokens[i] for i in np.flatnonzero(n == 1)}
    assert len(made) > 0.99 * len(tokens)
    lost = [t for t in tokens if t not in made]
    assert not lost, lost[:5]


def test_long_words_take_the_same_merges(pairs, library):
    rng = random.Random(5)
    words = ["a" * 1000, "ab" * 300, "aba" * 99, "".join(rng.choice("abcdefgh") for _ in range(900)), "".join(rng.choice("가나다라漢字") for _ in range(400)), "-" * 777, "ñ" * 200]
    words += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(65, 200))) for _ in range(60)]
    for w, ids in zip(words, pairs.words([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(w)


def test_leftmost_pair_goes_first_and_whole_words_are_tokens():
    letters = {bytes([i]): i for i in range(256)}
    own = bytepairs.PairCodec(letters | {b"aa": 300, b"aab": 299, b"xyz": 301}, r"\S+|\s+")
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.words([b"aaa", b"aaab", b"xyz", b"xyzx"])] == [[300, 97], [300, 97, 98], [301], [120, 121, 122, 120]]


def test_ids_that_decode_to_other_bytes_show(pairs):
    own = bytepairs.PairCodec(bytepairs.read_ranks(RANKS), public_tokenizers.PATTERN)
    right = list(own.digests(["Wonderfully odd"]))
    own.db.execute("UPDATE vocabulary SET hex = '21'")
    own.cache.clear()
    (n, ids, data), (m, jds, other) = right[0], next(own.digests(["Wonderfully odd"]))
    assert (n, ids) == (m, jds) and data != other


def test_a_small_cache_and_small_queries_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bytepairs, "WORDS", 7)
    monkeypatch.setattr(bytepairs, "SLICE", 50)
    own = bytepairs.PairCodec(bytepairs.read_ranks(RANKS), public_tokenizers.PATTERN, cache=20)
    texts = wild(random.Random(8), 30)
    want = [library.encode_ordinary(t) for t in texts]
    assert [n for n, _, _ in own.digests(texts)] == [len(x) for x in want] and [own.encode(t) for t in texts] == want


# ---- alignment


def brute_alignment(rows):
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    v = alignment.Vocabularies(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
    out, count = [], Counter()
    for i, t in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if b"".join(v.a_bytes[k] for k in x) != (" " + t).encode() if t else True:
            x = y = []
        if t and b"".join(v.b_bytes[k] for k in y) != (" " + t).encode():
            x = y = []
        ends = [list(np.cumsum([len(s[k]) for k in ids])) for s, ids in ((v.a_bytes, x), (v.b_bytes, y))]
        both, p, q, groups, links = set(ends[0]) & set(ends[1]), 0, 0, [], []
        for e in sorted(both):
            m, n = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, x[p:m])) + "|" + ",".join(map(str, y[q:n])))
            links.append((x[m - 1], y[n - 1]))
            p, q = m, n
        count.update(links)
        out.append((i, len(x), len(y), groups, links))
    most = Counter()
    for (_, k), n in count.items():
        most[k] = max(most[k], n)
    return [(i, nx, ny, len(g), len(links), sum(count[ab] == most[ab[1]] for ab in links), sum(count[ab] for ab in links), hashlib.sha256(";".join(g).encode()).hexdigest() if nx else "") for i, nx, ny, g, links in out]


def test_alignment_equals_brute_force(spark, rows):
    got = alignment.align_documents(table(spark, rows), JSON, MODEL).collect()
    assert Counter(map(tuple, got)) == Counter(brute_alignment(rows))


def test_the_collector_rests_while_units_are_aligned(monkeypatch):
    """Spans are so many tuples that collections took a fifth of the time; afterwards, and after an error, it goes on."""
    own = alignment.Aligner(alignment.Vocabularies(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read()))
    seen, align = [], own.align
    monkeypatch.setattr(own, "align", lambda units: (seen.append(gc.isenabled()), align(units)))
    assert gc.isenabled() and next(own.texts(["two words"]))[0] > 0
    assert seen == [False] and gc.isenabled()
    monkeypatch.setattr(own, "align", lambda units: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        next(own.texts(["other units"]))
    assert gc.isenabled()


def test_alignment_by_shuffle_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    some = odd_rows()
    assert Counter(map(tuple, alignment.align_documents(table(spark, some), JSON, MODEL).collect())) == Counter(brute_alignment(some))


def test_spans_place_tokens_that_share_a_character():
    """é as two byte tokens between letters: characters alone would end both at the same byte."""
    start, end, size = np.array([0, 1, 1, 3]), np.array([1, 3, 3, 4]), np.array([1, 1, 1, 1])
    assert alignment.token_ends(start, end, size, np.zeros(4, bool)).tolist() == [1, 2, 3, 4]
    # Byte pieces of a character span nothing but the last, which spans it whole.
    part = np.array([False, True, False, False])
    assert alignment.token_ends(np.array([0, 1, 1, 3]), np.array([1, 1, 3, 4]), size, part).tolist() == [1, 2, 3, 4]


def test_pairs_that_can_end_together_are_bounded(spark, rows):
    v = alignment.Vocabularies(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
    counts = alignment.link_counts(alignment.aligned(table(spark, rows), JSON, MODEL))
    for r in counts.collect():
        a, b = v.a_bytes[r.pair >> 32], v.b_bytes[r.pair & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)
    assert counts.count() <= v.links() < alignment.BROADCAST_ROWS


# ---- importance resampling


def brute_resampling(docs, target, share=25, least=20, buckets=10_000):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def hashed(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(k for _, x in docs for k in hashed(x)), Counter(k for x in target for k in hashed(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (n_s + buckets) / ((s[k] + 1) * (n_t + buckets))))
    rows = []
    for i, x in docs:
        f = hashed(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: share * len(drawn) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def test_spans_have_the_remainder_of_the_library():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(20_000)), np.uint8)
    size = np.array([*range(1, 300), 5000, 63, 64, 65, 127, 128, 129, 1])
    start = np.array([rng.randrange(len(data) - n) for n in size])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size)]
    assert resampling.crc_spans(data, start, size).tolist() == want


@pytest.mark.parametrize("step", [1 << 20, 40])
def test_resampling_equals_brute_force(spark, rows, monkeypatch, step):
    monkeypatch.setattr(resampling, "STEP", step)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "漢字", "x" * 150]
    docs = rows + [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 60)))) for i in range(300)]
    target = [(i, " ".join(rng.choice(vocabulary[:10]) for _ in range(30))) for i in range(20)] + [(99, None)]
    got = resampling.resample(table(spark, docs), table(spark, target))
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == Counter(brute_resampling(docs, [t for _, t in target]))


def test_texts_are_cut_anywhere_without_change(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b", None, "", "C d E", "x" * 100, "é"])
    want = [resampling.features(d, b)[2].tolist() for _, d, b in resampling.slices(texts)][0]
    monkeypatch.setattr(resampling, "SLICE", 3)
    parts = [(lo, resampling.features(d, b)[2].tolist()) for lo, d, b in resampling.slices(texts)]
    assert sorted(x for _, p in parts for x in p) == sorted(want) and [lo for lo, _ in parts] == sorted({lo for lo, _ in parts})
    assert [resampling.features(d, b)[2].tolist() for _, d, b in resampling.slices(texts.slice(3, 1))] == [[zlib.crc32(x) for x in (b"c", b"d", b"e", b"c d", b"d e")]]


def test_empty_tables_give_no_rows(spark):
    none, some = table(spark, []), table(spark, [(1, "a b c")])
    assert bytepairs.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert alignment.align_documents(none, JSON, MODEL).count() == 0
    assert resampling.resample(none, some).count() == 0
    assert [r.rank for r in resampling.resample(some, none).collect()] == [None]


def test_equal_scores_rank_by_id_and_repeated_rows_follow_each_other(spark):
    docs = [(i % 5, " ".join(f"w{k}" for k in range(25))) for i in range(40)]
    got = resampling.resample(table(spark, docs), table(spark, docs), share=50).where(F.col("rank").isNotNull()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)
