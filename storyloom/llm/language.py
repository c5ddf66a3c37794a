"""Language identification of words by a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import scratch

#: Feature slots and documents of each language to fit on (documents with the smallest hashes; whole texts).
SLOTS, SAMPLE = 1 << 15, 200
#: Words of a fitting document come in sequences of this length.
SPAN = 64
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. The pattern also takes numerals such as fractions and superscripts; these part words."""
    out = []
    for w in LETTERS.findall((text or "").lower()):
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def word_features(word: str) -> list[int]:
    """Slots of a lower-case word: itself, affixes of one to three letters, trigrams, its length."""
    w = f"<{word}>"
    names = [w, "#%d" % min(len(word), 12)]
    names += ["p" + word[:k] for k in range(1, min(3, len(word)) + 1)] + ["s" + word[-k:] for k in range(1, min(3, len(word)) + 1)]
    names += [w[i : i + 3] for i in range(len(w) - 2)]
    return [_slot(x) for x in names]


@lru_cache(1 << 17)
def slots_of(word: str) -> tuple[int, ...]:
    return tuple(word_features(word))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & SLOTS - 1


@dataclass
class Model:
    """labels; emission weights [SLOTS, L]; transition weights [L, L]; start weights [L]; lexicon log ratios [SLOTS, L]."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    lexicon_weight: np.ndarray


class Scorer:
    """Emission scores of words, kept for each distinct word up to a limit."""

    def __init__(self, model: Model, limit: int = 600_000):
        self.m, self.limit, self.known = model, limit, {}
        self.scores = np.zeros((1024, len(model.labels)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, list(set(words))
        if new:
            slots = [word_features(w) for w in new]
            sizes = np.fromiter(map(len, slots), np.int64, len(slots))
            flat = np.fromiter(chain.from_iterable(slots), np.int64, sizes.sum())
            starts = np.cumsum(sizes) - sizes
            score = np.add.reduceat(self.m.emit[flat], starts, axis=0) / np.sqrt(sizes)[:, None]
            score = score + self.m.lexicon_weight * self.m.lexicon[flat[starts]]  # the word's own slot comes first
            at = len(self.known)
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at : at + len(new)] = score
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, model: Model, expect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each word and summed expected transitions (if expect), for sequences laid end to end; all sequences step together."""
    n, size = len(lengths), emission.shape[1]
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    long_ = lengths[order]
    p = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32)
    step, begin = (np.exp(x - x.max()).astype(np.float32) for x in (model.move, model.start))
    one = np.ones((size, 1), np.float32)  # row sums as a product: faster than a sum over a short axis
    alpha, beta = np.empty_like(p), np.empty_like(p)
    moves = np.zeros((size, size))
    top = int(long_[0]) if n else 0
    active = n - np.searchsorted(long_[::-1], np.arange(top), side="right")  # sequences longer than t
    for t in range(top):
        at = first[: active[t]] + t
        a = p[at] * (begin if t == 0 else alpha[at - 1] @ step)
        alpha[at] = a / (a @ one)
    for t in range(top - 1, -1, -1):
        at = first[: active[t]] + t
        k = active[t + 1] if t + 1 < top else 0
        beta[at[k:]] = 1.0
        if k:
            nxt = at[:k] + 1
            pb = p[nxt] * beta[nxt]
            b = pb @ step.T
            if expect:
                joint = np.einsum("ni,ij,nj->nij", alpha[at[:k]], step, pb)
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[at[:k]] = b / (b @ one)
    post = alpha * beta
    return post / np.maximum(post @ one, 1e-30), moves


def train_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(id, text, lang) that may be learned from: lang known, crc32(doc_id as text) not divisible by folds."""
    keep = F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != 0)
    return docs.where(keep).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def lexicon_counts(rows: DataFrame) -> DataFrame:
    """(lang, slot, n): how often words of each slot occur in each language, over all rows; SLOTS rows a language at most."""

    def run(batches):
        slot_of: dict[str, int] = {}
        for b in batches:
            counts: dict[str, np.ndarray] = {}
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                words = words_of(text.as_py())
                if len(slot_of) > 300_000:
                    slot_of.clear()
                for w in words:
                    if w not in slot_of:
                        slot_of[w] = _slot(f"<{w}>")
                if words:
                    counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                    counts[lang] += np.bincount(np.fromiter((slot_of[w] for w in words), np.int64, len(words)), minlength=SLOTS)
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "slot", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, folds: int = 5, sample: int = SAMPLE, rounds: int = 10, rate: float = 0.5, seed: int = 42) -> Model:
    """Maximum likelihood by AdaGrad over the gradient that Spark sums over a bounded sample in each round.

    The lexicon counts every row; the weights are fitted on the `sample` documents of each language with the smallest
    hashes. Labels of words are their document's language; a third of the sequences joins halves of two documents of
    different languages, so that transitions between languages are learned too.
    """
    rows = train_rows(docs, folds)
    counts = scratch(lexicon_counts(rows), "lexicon").toPandas()  # SLOTS rows a language at most
    labels = sorted(set(counts["lang"]))
    if not labels:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros((SLOTS, 0)), np.zeros(0))
    index = {x: i for i, x in enumerate(labels)}
    table = np.full((SLOTS, len(labels)), 0.5)
    np.add.at(table, (counts["slot"].to_numpy(), counts["lang"].map(index).to_numpy()), counts["n"].to_numpy())
    table /= table.sum(axis=0)
    lexicon = (np.log(table) - np.log(table).mean(axis=1, keepdims=True)).astype(np.float32)
    ranked = rows.withColumn("h", F.xxhash64(F.col("id"), F.lit(seed)))
    cut = ranked.groupBy("lang").agg(F.count("*").alias("n"))
    # Hashes are uniform: a threshold gives the wanted number of documents without sorting them.
    cut = cut.withColumn("limit", (F.lit(-(2.0**63)) + F.least(F.lit(1.0), sample / F.col("n")) * F.lit(2.0**64)).cast("double")).select("lang", "limit")
    picked = scratch(ranked.join(F.broadcast(cut.limit(len(labels))), "lang").where(F.col("h").cast("double") <= F.col("limit")).select("id", "text", "lang"), "sample")
    parts = max(2, min(16, picked.count() // 200 + 1))
    picked = scratch(picked.repartition(parts, "id"), "sample").select("text", "lang")
    size = len(labels)
    model = Model(labels, np.zeros((SLOTS, size)), np.zeros((size, size)), np.zeros(size), lexicon, np.full(size, 0.3))
    square = [np.full_like(x, 1e-3) for x in (model.emit, model.move, model.start, model.lexicon_weight)]
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shipped = context.broadcast(model)

        def gradient(batches, shipped=shipped, seed=seed):
            m = shipped.value
            total, words_seen = None, 0
            for b in batches:
                g, n = sequence_gradient([t.as_py() for t in b.column("text")], b.column("lang").to_pylist(), m, seed)
                total = g if total is None else [x + y for x, y in zip(total, g, strict=True)]
                words_seen += n
            if total is not None:
                at = np.flatnonzero(np.abs(total[0]).sum(axis=1))
                dense = np.concatenate([x.ravel() for x in total[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[0][at].tolist(), [*dense.tolist(), float(words_seen)]], pa.list_(pa.float64()))], ["slot", "g"])

        summed = picked.mapInArrow(gradient, "slot int, g array<double>").select("slot", F.posexplode("g").alias("k", "v")).groupBy("slot", "k").agg(F.sum("v").alias("v"))
        got = summed.toPandas()  # SLOTS x labels at most
        shipped.unpersist()
        dense = got[got["slot"] == -1].sort_values("k")["v"].to_numpy()
        words = max(dense[-1], 1.0)
        grads = [np.zeros((SLOTS, size)), dense[: size * size].reshape(size, size), dense[size * size : size * size + size], dense[size * size + size : -1]]
        rest = got[got["slot"] >= 0]
        grads[0][rest["slot"], rest["k"]] = rest["v"]
        for x, g, s in zip((model.emit, model.move, model.start, model.lexicon_weight), grads, square, strict=True):
            g = g / words * 100 - 1e-4 * x
            s += g * g
            x += rate * g / np.sqrt(s)
    return model


def sequence_gradient(texts: list[str], langs: list[str], model: Model, seed: int) -> tuple[list[np.ndarray], int]:
    index = {x: i for i, x in enumerate(model.labels)}
    spans = []
    for text, lang in zip(texts, langs, strict=True):
        words = words_of(text)
        spans += [(words[i : i + SPAN], index[lang]) for i in range(0, len(words), SPAN)]
    seqs = [(w, [y] * len(w)) for w, y in spans]
    rng = np.random.default_rng(seed)
    perm = rng.permutation(len(spans))
    for i in perm[: len(spans) // 3]:  # code-switched sequences
        (a, x), (b, y) = spans[i], spans[perm[rng.integers(len(perm))]]
        if x != y:
            a, b = a[: len(a) // 2 + 1], b[len(b) // 2 :]
            seqs.append((a + b, [x] * len(a) + [y] * len(b)))
    lengths = np.array([len(w) for w, _ in seqs])
    words = [w for s, _ in seqs for w in s]
    size = len(model.labels)
    grads = [np.zeros((SLOTS, size)), np.zeros((size, size)), np.zeros(size), np.zeros(size)]
    if not words:
        return grads, 0
    gold = np.array([y for _, s in seqs for y in s])
    post, moves = forward_backward(Scorer(model).rows(words), lengths, model)
    diff = -post
    diff[np.arange(len(gold)), gold] += 1
    begin = np.cumsum(lengths) - lengths
    grads[2] = diff[begin].sum(axis=0)
    inner = np.ones(len(gold), bool)
    inner[begin] = False
    np.add.at(grads[1], (gold[np.flatnonzero(inner) - 1], gold[inner]), 1.0)
    grads[1] -= moves
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    by_word = np.zeros((len(seen), size))
    np.add.at(by_word, ids, diff)
    for w, g in zip(seen, by_word, strict=True):
        slots = slots_of(w)
        np.add.at(grads[0], list(slots), g / len(slots) ** 0.5)
        grads[3] += g * model.lexicon[slots[0]]
    return grads, len(words)


def label_documents(docs: DataFrame, model: Model, folds: int = 5, words_at_once: int = 400_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: the language with the largest sum of word posteriors, and its share.

    `und` with score 0 where text is null or has no letter, or where nothing could be learned. Ties go to the first
    label by code point. Only doc_id and text are read; repeated rows get equal rows, an empty table none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        scorer = Scorer(m)
        for b in batches:
            out = [(UND, 0.0)] * b.num_rows
            words, lengths, rows = [], [], []

            def flush(out=out):
                nonlocal words, lengths, rows
                if words:
                    post, _ = forward_backward(scorer.rows(words), np.array(lengths), m, False)
                    mass = np.add.reduceat(post.astype(np.float64), np.cumsum(lengths) - lengths, axis=0)
                    for r, v, n in zip(rows, mass, lengths, strict=True):
                        k = int(v.argmax())
                        out[r] = (m.labels[k], min(1.0, float(v[k]) / n))
                words, lengths, rows = [], [], []

            for i, t in enumerate(b.column("text")):
                own = words_of(t.as_py()) if m.labels else []
                if own:
                    words += own
                    lengths.append(len(own))
                    rows.append(i)
                if len(words) > words_at_once:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
