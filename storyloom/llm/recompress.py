"""Substring dedup over words by recompression.

A text's words become symbols; each round names maximal runs of one symbol, then pairs (left, right) of the two halves
into which the round deals the alphabet. Whether two neighbours merge depends on them alone, so equal passages get equal
symbols but for a bounded fringe. A name is a 64-bit hash of what it stands for: every task gives equal runs and pairs
the same name without an exchange. Spark then finds which high-level names occur twice or more; only windows over
such symbols are compared, by 128-bit fingerprints of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import repeats
from storyloom.llm.common import mix, scratch

#: Words of a window; rounds of recompression; symbols in a row that make an anchor; words handled at once.
WINDOW, ROUNDS, GRAM, AT_ONCE = 20, 2, 3, 400_000


class Names(dict):
    """Hash of each word, kept up to a limit."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word, self.seed) or 1
        return x


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def batches_of(texts, most: int = AT_ONCE):
    """(indices, words of each, all words) for consecutive texts, of about `most` words."""
    at, per, n = [], [], 0
    for i, t in enumerate(texts):
        w = words_of(t.as_py() if hasattr(t, "as_py") else t)
        at.append(i)
        per.append(w)
        n += len(w)
        if n >= most:
            yield at, per
            at, per, n = [], [], 0
    if at:
        yield at, per


def one_round(sym: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after naming runs and pairs; for each old symbol the index of its run, and for each run that of its new symbol; and which runs may merge to the right.

    Symbol 0 stands between texts and never merges.
    """
    start = np.ones(len(sym), bool)
    start[1:] = (sym[1:] != sym[:-1]) | (sym[1:] == 0)
    first = np.flatnonzero(start)
    run_of = np.cumsum(start) - 1
    length = np.diff(np.append(first, len(sym)))
    runs = np.where(length == 1, sym[first], mix(sym[first], length) | np.uint64(1))
    left = (mix(runs, salt) & np.uint64(1)).astype(bool)
    inner = runs != 0
    joined = np.zeros(len(runs), bool)
    joined[1:] = left[:-1] & ~left[1:] & inner[:-1] & inner[1:]
    new_of = np.cumsum(~joined) - 1
    head = np.flatnonzero(~joined)
    pair = np.zeros(len(head), bool)
    pair[new_of[joined]] = True
    names = runs[head].copy()
    names[pair] = mix(runs[head[pair]], runs[head[pair] + 1]) | np.uint64(1)
    return names, run_of, new_of, left


def anchors(ths: list[int], texts, window: int = WINDOW, rounds: int = ROUNDS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each window the rarest-named group of `gram` symbols that is certain inside it, as runs of windows that share one.

    Symbols at a window's edge may differ with what stands outside: each round gives up the first and last run, then a
    first symbol that may merge to the left and a last one that may merge to the right. Windows without enough certain
    symbols (long runs) are anchors of their own.
    """
    names, out = Names(0), {k: [] for k in ("h", "th", "pos", "a", "b")}
    for at, per in batches_of(texts):
        flat, begin, count = [], [], []
        for w in per:
            if len(w) >= window:
                begin.append(len(flat) + 1 + len(begin))  # a 0 before each text
                count.append(len(w))
                flat += w
        if not flat:
            continue
        kept = [i for i, w in zip(at, per, strict=True) if len(w) >= window]
        begin, count = np.array(begin), np.array(count)
        sym = np.zeros(len(flat) + len(begin) + 1, np.uint64)
        inside = np.ones(len(sym), bool)
        inside[begin - 1] = inside[-1] = False
        sym[inside] = np.fromiter(map(names.__getitem__, flat), np.uint64, len(flat))
        starts = np.concatenate([np.arange(b, b + c - window + 1) for b, c in zip(begin, count, strict=True)])
        doc = np.repeat(np.arange(len(begin)), count - window + 1)
        whole = rolling(sym, window, 0x9E3779B97F4A7C15)
        lo, hi, place, s = starts.copy(), starts + window, np.arange(len(sym)), sym
        for k in range(rounds):
            s, run_of, new_of, left = one_round(s, k + 1)
            lo, hi = run_of[lo] + 1, np.maximum(run_of[hi - 1], 1)  # runs lo..hi-1 are whole
            lo = np.minimum(lo, len(left) - 1)
            lo = lo + ~left[lo]
            hi = hi - left[hi - 1]
            lo, hi = np.minimum(lo, len(left)), np.maximum(hi, 0)
            ok = lo < hi
            lo = np.where(ok, new_of[np.minimum(lo, len(left) - 1)], 0)
            hi = np.where(ok, new_of[np.maximum(hi, 1) - 1] + 1, 0)
            firsts = np.flatnonzero(np.diff(new_of, prepend=-1))
            run_first = np.flatnonzero(np.diff(run_of, prepend=-1))
            place = place[run_first[firsts]]
            hi = np.maximum(hi, lo)
            lo, hi = np.where(ok, lo, 1), np.where(ok, hi, 1)  # an empty range that the next round keeps empty
        # Names of `gram` symbols in a row; those from lo to hi - gram lie inside.
        g = s
        for j in range(1, gram):
            g = mix(g[:-1], s[j:])
        many = hi - lo - gram + 1
        good = many > 0
        anchor, h = starts.copy(), mix(whole[starts], 77)
        if good.any():
            key = (mix(g, 5) >> np.uint64(28) << np.uint64(28)) | np.arange(len(g), dtype=np.uint64)
            best = range_min(key, lo[good], many[good])
            index = (best & np.uint64((1 << 28) - 1)).astype(np.int64)
            anchor[good], h[good] = place[index], g[index]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | ~good[1:]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        out["h"].append(h[first])
        out["th"].append(np.array([ths[i] for i in kept], np.int64)[doc[first]])
        out["pos"].append(anchor[first] - begin[doc[first]])
        out["a"].append(anchor[first] - starts[first])
        out["b"].append(anchor[first] - starts[last])
    return {k: np.concatenate(v) if v else np.zeros(0, repeats.KINDS[k]) for k, v in out.items()}


def rolling(x: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hash of every `window` values in a row, modulo 2^64 (base is odd)."""
    with np.errstate(over="ignore"):
        powers = np.full(len(x) + 1, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        back = np.full(len(x) + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[:-1], dtype=np.uint64)])
        if len(x) < window:
            return np.zeros(0, np.uint64)
        return (sums[window:] - sums[:-window]) * back[: len(x) - window + 1]


def range_min(x: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minimum of x[lo : lo + n] for each pair, with minima over powers of two."""
    out, level = np.empty(len(lo), x.dtype), x
    log = np.frexp(n.astype(np.float64))[1] - 1
    for k in range(int(log.max()) + 1):
        at = log == k
        out[at] = np.minimum(level[lo[at]], level[lo[at] + n[at] - (1 << k)])
        if len(level) <= 1 << k:
            break
        level = np.minimum(level[: -(1 << k)], level[1 << k :])
    return out


RUNS = "bucket int, id binary, th binary, start binary, n binary, w1 binary, w2 binary"


def windows(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Fingerprints of the windows at repeated anchors, in buckets by anchor; docs: (id, th, text, anchors)."""

    def run(batches):
        one, two = Names(11), Names(12)
        for b in batches:
            parts: dict[str, list] = {k: [] for k in ("h", "id", "th", "start", "n", "w1", "w2")}
            ids, ths, places = b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("anchors")
            for at, per in batches_of(b.column("text")):
                flat = [w for ws in per for w in ws]
                w1 = rolling(np.fromiter(map(one.__getitem__, flat), np.uint64, len(flat)), window, 0x9E3779B97F4A7C15)
                w2 = rolling(np.fromiter(map(two.__getitem__, flat), np.uint64, len(flat)), window, 0xD1342543DE82EF95)
                begin = 0
                for i, ws in zip(at, per, strict=True):
                    found = places[i].values.flatten() if places[i].is_valid else None
                    if found is not None and len(found[0]):
                        pos, a, e, h = (c.to_numpy(zero_copy_only=False) for c in found)
                        start, n = pos - a, a - e + 1
                        where = np.repeat(begin + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        for k, v in (("h", h.view(np.uint64)), ("id", np.full(len(n), ids[i])), ("th", np.full(len(n), ths[i])), ("start", start), ("n", n), ("w1", mix(w1[where])), ("w2", mix(w2[where], 1))):
                            parts[k].append(v)
                    begin += len(ws)
            if not parts["h"]:
                continue
            c = {k: np.concatenate(v) for k, v in parts.items()}
            # Of equal windows of a batch only the first goes on; the others are known to occur earlier (bucket -1).
            run_of = np.repeat(np.arange(len(c["n"])), c["n"])
            at = np.repeat(c["start"], c["n"]) + np.arange(len(run_of)) - np.repeat(np.cumsum(c["n"]) - c["n"], c["n"])
            known = occurs_earlier(c["id"][run_of], c["th"][run_of], at, c["w1"], c["w2"])
            bucket = (c["h"] % np.uint64(buckets)).astype(np.int64)[run_of]
            bucket[known] = -1
            rows = []
            for k in np.unique(bucket).tolist():
                chosen = bucket == k
                lo, hi = stretches(run_of, chosen)
                shown = chosen if k >= 0 else np.zeros(0, np.int64)
                r = run_of[lo]
                rows.append((k, c["id"][r].astype(np.int64).tobytes(), c["th"][r].astype(np.int64).tobytes(), at[lo].astype(np.int64).tobytes(), (hi - lo + 1).astype(np.int32).tobytes(), c["w1"][shown].tobytes(), c["w2"][shown].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], ["bucket", "id", "th", "start", "n", "w1", "w2"])

    return docs.mapInArrow(run, RUNS)


def occurs_earlier(ids, ths, at, w1, w2) -> np.ndarray:
    """Whether a window's words also start at an earlier place (id, th, at) among these windows."""
    order = np.lexsort((at, ths, ids, w2, w1))
    a, b, i, t, p = w1[order], w2[order], ids[order], ths[order], at[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    head = np.flatnonzero(~same)
    first = head[np.cumsum(~same) - 1] if len(a) else head
    gone = np.zeros(len(a), bool)
    gone[order] = (i != i[first]) | (t != t[first]) | (p != p[first])
    return gone


def stretches(run: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of chosen windows within a run."""
    new, last = np.ones(len(run), bool), np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | ~chosen[:-1]
    last[:-1] = (run[1:] != run[:-1]) | ~chosen[1:]
    return np.flatnonzero(chosen & new), np.flatnonzero(chosen & last)


def later(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, th, lo, hi): ranges of window starts whose words occur earlier, among the windows of one bucket."""
    ids, ths, start, n, w1, w2 = (np.frombuffer(b"".join(pdf[k]), t) for k, t in (("id", np.int64), ("th", np.int64), ("start", np.int64), ("n", np.int32), ("w1", np.uint64), ("w2", np.uint64)))
    run = np.repeat(np.arange(len(n)), n)
    at = np.repeat(start, n) + np.arange(len(w1)) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = stretches(run, occurs_earlier(ids[run], ths[run], at, w1, w2))
    return pd.DataFrame({"id": ids[run[lo]], "th": ths[run[lo]], "lo": at[lo], "hi": at[hi] + 1})


def known_ranges(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, ths, start, n = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in (("id", np.int64), ("th", np.int64), ("start", np.int64), ("n", np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.array(start), pa.array(start + n)], ["id", "th", "lo", "hi"])


FOUND = "id long, th long, lo long, hi long"


def dedup_words(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with keep_text: text, of the kept words) for each row of docs.

    A word goes if a window of `window` words covers it that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Texts that share an id, or have none, are ordered by a hash. Of equal texts only the one with
    the smallest doc_id is searched; the others lose every window. A very long text is one row: memory grows with its
    words. Rows that agree in doc_id and text are one document; null doc_ids are one largest id. Null and empty
    texts have no word. Other columns are not read; an empty table gives no row.
    """
    base = repeats.base_of(docs)
    status = repeats.statuses(base)
    buckets = repeats.buckets_for(status)
    places = repeats.repeated_anchors(base, lambda ths, texts: anchors(ths, texts, window), buckets)
    packed = scratch(windows(repeats.with_anchors(base, status, places), buckets, window), "windows")
    found = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(later, FOUND)
    found = found.union(packed.where("bucket < 0").mapInArrow(known_ranges, FOUND))
    told = repeats.with_spans(base, status, found)

    def run(batches):
        for b in batches:
            rows = []
            spans, copy = b.column("spans").to_pylist(), b.column("copy").to_pylist()
            for i, t in enumerate(b.column("text")):
                words = words_of(t.as_py())
                kept = words
                if copy[i] and len(words) >= window:
                    kept = []
                elif spans[i]:
                    gone = repeats.covered(len(words), spans[i], window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if keep_text else None))
            n, r, s, x = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    return told.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)


#: The same over whole tables for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS k FROM p),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM h) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS w FROM g),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS w FROM d),
k AS (SELECT a.doc_id, a.w, a.word FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.w = a.w WHERE c.w IS NULL),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w) AS x FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.x, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
