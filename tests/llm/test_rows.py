"""Rows that share an id, columns with clashing names, several commits, hot keys and short passages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_fingerprint, table

from storyloom.llm import common, language, lines, media, mixing, recompress, repeats, simhash, suffixes, vectors


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rng = random.Random(51)
    a, b = words(rng, 200), words(rng, 200)
    near = next(x for x in (a + f" tail{k}" for k in range(100)) if 0 < bin(brute_fingerprint(x) ^ brute_fingerprint(a)).count("1") <= 2)
    kept = simhash.drop_near_duplicates(table(spark, [(0, a, "en", "s"), (1, b, "en", "s"), (1, near, "en", "s"), (None, b, "en", "s"), (None, words(rng, 90), "en", "s")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text == a, r.text == b) for r in kept) == [(False, 0, True, False), (False, 1, False, True), (True, 0, False, False)]
    got = simhash.near_duplicates(table(spark, [(0, a, "en", "s"), (1, b, "en", "s"), (1, near, "en", "s")])).collect()
    assert {(r.fingerprint, r.component_id) for r in got} == {(f"{brute_fingerprint(x):016x}", c) for x, c in ((a, 0), (near, 0), (b, 1))}


def test_media_of_several_commits(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = [table(spark, [(i, f"text {i}", "en", "s") for i in r]) for r in (range(3), range(3, 5), range(9, 10))]
    media.store_documents(rows[0], path)
    media.store_documents(rows[1], path)
    assert sorted(r.doc_id for r in media.read_media(spark, path).collect()) == [0, 1, 2, 3, 4]
    media.store_documents(rows[2], path, "overwrite")
    assert [r.doc_id for r in media.read_media(spark, path).collect()] == [9]


def test_media_short_reads_are_tried_again(spark, tmp_path):
    media.store_documents(table(spark, [(i, f"text {i}", "en", "s") for i in range(4)]), f"file://{tmp_path}/m")
    reader, calls = media.MediaReader({"path": f"file://{tmp_path}/m"}), []

    class Short:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            calls.append(n)
            return self.f.read(n)[:10] if len(calls) in (1, 3) else self.f.read(n)

    real = media.MediaReader.take
    reader.take = lambda f, info: real(Short(f), info)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_helper_names_are_free(spark):
    rng = random.Random(52)
    block = "\n".join(words(rng, 4) for _ in range(30))
    d = table(spark, [(i, f"{i}\n{block}", "en", "s") for i in range(3)])
    for c in ("gone", "copies", "chunk", "h", "size", "target", "ordinal", "first", "times", "t"):
        d = d.withColumn(c, F.lit(c))
    out = lines.dedup_lines(d)
    assert out.columns == [*d.columns, "__n_lines", "__n_removed"] and {r.gone for r in out.collect()} == {"gone"}
    mix = mixing.mixed(d)
    assert mix.columns == d.columns and {r.copies for r in mix.collect()} == {"copies"}
    assert simhash.drop_near_duplicates(d).columns == d.columns


def test_mix_of_one_id_with_several_texts_is_steady(spark):
    rng = random.Random(53)
    d = table(spark, [(i % 5, words(rng, 20), "en", "a" if i % 3 else "b") for i in range(60)])
    runs = [sorted(r.text for r in mixing.mixed(d.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1]


def brute_lines(rows):
    """Lines that a chunk of two lines or more covers that occurs earlier, with boundaries by the same rule."""
    import hashlib

    def cut(ls):
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
        e = [i for i in range(1, len(ls)) if ((h[i - 1] * 31 + h[i]) % lines.PRIME * lines.FACTOR % lines.PRIME >> 12) % lines.DIVISOR == 0]
        spans = list(zip([0, *(x - 1 for x in e)], [*e, len(ls) - 1], strict=True)) + [(x - 1, x) for x in e]
        return {s for s in spans if s[1] > s[0]}

    first, out = {}, {}
    for i, t in sorted(rows):
        ls = t.split("\n")
        for a, b in sorted(cut(ls)):
            first.setdefault(tuple(ls[a : b + 1]), (i, a))
    for i, t in rows:
        ls = t.split("\n")
        gone = {k for a, b in cut(ls) for k in range(a, b + 1) if first[tuple(ls[a : b + 1])] != (i, a) and any(ls[a : b + 1])}
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


@pytest.mark.parametrize("hot", [2, 150])
def test_lines_match_brute_force(spark, hot):
    rng = random.Random(54)
    pool = [[words(rng, 3) for _ in range(rng.randint(2, 10))] for _ in range(6)] + [["x"] * 7, ["", "", ""], ["a", "a", "b"]]
    rows = [(i, "\n".join(x for _ in range(4) for x in [words(rng, 2), *rng.choice(pool)])) for i in range(30)]
    rows += [(100 + i, "\n".join([f"own {i}", *pool[0], f"end {i}"])) for i in range(hot)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize(("size", "least"), [(2, 0.35), (3, 0.45), (5, 0.55), (7, 0.65), (10, 0.7)])
def test_lines_recall_on_short_passages(spark, size, least):
    """Of passages that two documents share, in contexts of their own, the share of the second's lines that go: all but about one at each end."""
    rng = random.Random(size)
    passages = [[words(rng, 5) for _ in range(size)] for _ in range(150)]
    rows = [(k * 1000 + i, "\n".join([words(rng, 5), words(rng, 5), *p, words(rng, 5), words(rng, 5)]), "en", "s") for k in (0, 1) for i, p in enumerate(passages)]
    out = lines.dedup_lines(table(spark, rows)).collect()
    assert sum(r["__n_removed"] for r in out if r.doc_id < 1000) == 0
    assert all(len(r.text.split("\n")) >= 4 for r in out)
    share = sum(r["__n_removed"] for r in out) / (150 * size)
    assert share >= least, share


def test_numerals_are_no_letters(spark):
    assert language.words_of("½ ² Ab½c x² Ⅳ") == ["ab", "c", "x"] and language.words_of(None) == []
    d = table(spark, [(i, "der die das und" if i % 2 else "the and of with", "de" if i % 2 else "en", "s") for i in range(60)])
    model = language.fit(d, rounds=2)
    got = language.label_documents(table(spark, [(1, "½ ²", None, "s"), (2, "ⅷ ٣", None, "s"), (3, "the ½", None, "s")]), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["und", "und", "en"]


def test_hot_keys_are_dealt_out(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    small = common.scratch(big.groupBy("k").agg(F.count("*").alias("n")), "t")
    a, b = common.spread(big, small, ["k"], "n", ["id"])
    assert a.where("k = 0").select(common.SALT).distinct().count() == 64 and a.where("k > 0").select(common.SALT).distinct().count() == 1
    assert a.join(b, ["k", common.SALT]).count() == 5000 and b.where("k = 0").count() == 64


def test_entries_of_a_vector_stay_few_as_pivots_grow(spark):
    """Tight groups in many directions: with the plane between two pivots as bound, few cells are near a vector."""
    rng = np.random.default_rng(55)
    base = rng.normal(size=(60, 32))
    x = (base[rng.integers(60, size=1500)] + 0.05 * rng.normal(size=(1500, 32))).tolist()
    d = spark.createDataFrame([(0, 32, i, 1, v) for i, v in enumerate(x)], "label long, dim int, rep long, n long, v array<double>")
    counts = []
    for cell in (300, 50):
        p = vectors.pivots_of(d, cell, 4096)
        counts.append((len(p[(0, 32)]), vectors.assign(d, p, (2 - 2 * 0.93) ** 0.5).count() / 1500))
    assert counts[1][0] > 3 * counts[0][0] and counts[1][1] < 0.5 * counts[1][0], counts


def test_passages_of_many_documents(spark):
    """One passage in many documents: equal windows of a batch meet before the exchange, and results stay those of brute force."""
    from test_llm import brute_bytes, brute_words

    rng = random.Random(56)
    passage = words(rng, 45)
    rows = [(i, f"{words(rng, 22)} {passage} {words(rng, 3)}") for i in range(120)]
    d = table(spark, [(i, t, "en", "s") for i, t in rows])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.dedup_words(d).collect()} == brute_words(rows, 20)
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_bytes(d).collect()} == brute_bytes([(i, t.encode()) for i, t in rows], 200)
    assert repeats.statuses(repeats.base_of(d)).count() == 120
