"""Importance resampling of documents towards a target's distribution of hashed words and word pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import scratch

#: Number of buckets; bytes of a span that one table covers; bytes of spans that are looked up at once; bytes of text that are cut at once.
BUCKETS, BLOCK, STEP, SLICE = 10_000, 64, 1 << 20, 1 << 22
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the remainder at each distance from the end of a span, flat, and what the initial value adds by length."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    place, start = [x], [np.uint32(0xFFFFFFFF)]
    for _ in range(BLOCK):
        place.append((place[-1] >> np.uint32(8)) ^ x[place[-1] & np.uint32(255)])
        start.append((start[-1] >> np.uint32(8)) ^ x[start[-1] & np.uint32(255)])
    return np.concatenate(place[:BLOCK]), np.array(start, dtype=np.uint32)


PLACE, START = _tables()
IS_WORD = np.ones(256, bool)
IS_WORD[:0x80] = [chr(b).isalnum() for b in range(0x80)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _blocks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The remainders of spans of 1 to BLOCK bytes, without the initial value: XOR over the bytes' entries in the table."""
    out, total, lo = np.zeros(len(start), np.uint32), np.cumsum(size), 0
    while lo < len(start):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + STEP, "right")))
        n = size[lo:hi]
        first = total[lo:hi] - n - before
        i = np.arange(int(n.sum()))
        byte = data[np.repeat(start[lo:hi] - first, n) + i]
        from_end = np.repeat(first + n - 1, n) - i
        out[lo:hi] = np.bitwise_xor.reduceat(PLACE[from_end * 256 + byte], first)
        lo = hi
    return out


def crc_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, none of them empty. A long span is cut into blocks from its end; each step carries the remainder over one more block."""
    count = (size + BLOCK - 1) // BLOCK
    head = size - BLOCK * (count - 1)
    state = _blocks(data, start, head) ^ START[head]
    most, j = int(count.max(initial=1)), 1
    long = np.flatnonzero(count > 1)
    while j < most:
        long = long[count[long] > j]
        x = state[long]
        moved = np.zeros(len(x), np.uint32)
        for k in range(4):
            moved ^= PLACE[(BLOCK - 1 - k) * 256 + ((x >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
        state[long] = moved ^ _blocks(data, start[long] + head[long] + BLOCK * (j - 1), np.full(len(long), BLOCK))
        j += 1
    return state ^ np.uint32(0xFFFFFFFF)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, CRC-32 of each feature) of the texts that lie between bounds in data.

    All bytes of a word are looked at together: words go one after the other, with a space after each, so a word and
    a pair of words are spans of the same bytes. Bytes from 0x80 on are parts of words, so UTF-8 is never split.
    """
    word = IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[edge] = word[edge]
    at = np.flatnonzero(first)
    none = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(len(bounds) - 1, np.int64), none, none.astype(np.uint32)
    place = np.flatnonzero(word)
    number = np.cumsum(first)[place] - 1  # which word a byte is in
    size = np.bincount(number, minlength=len(at))
    spaced = np.full(len(place) + len(at), 0x20, np.uint8)
    spaced[np.arange(len(place)) + number] = LOWER[data[place]]
    start = np.cumsum(size + 1) - size - 1
    text = np.searchsorted(bounds, at, "right") - 1
    pair = np.flatnonzero(text[1:] == text[:-1])
    crc = crc_spans(spaced, np.concatenate([start, start[pair]]), np.concatenate([size, size[pair] + 1 + size[pair + 1]]))
    return np.bincount(text, minlength=len(bounds) - 1), np.concatenate([text, text[pair]]), crc


def slices(texts: pa.Array):
    """(first text, bytes, bounds) of some texts at a time; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1))
        yield lo, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any. A task sends one row a bucket."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, bounds in slices(b.column("text")):
                n += np.bincount(features(data, bounds)[2] % buckets, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: the floor of 1000 times the log of how much likelier it is in the target, with one added to each count."""
    both = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    n = scratch(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = n.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    x = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double"))
    return n.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(x)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs: the floored mean gain of a text's features, 0 without any."""
    of = np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as buckets, whatever the size of docs
        of[r.bucket] = r.gain

    def run(batches):
        for b in batches:
            out = []
            for _, data, bounds in slices(b.column("text")):
                words, text, crc = features(data, bounds)
                n = np.bincount(text, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, text, of[crc % buckets])
                out.append(np.stack([words, n, total // np.maximum(n, 1)]))
            rows = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x) for x in rows]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs: `share` percent of those with `least` words or more are drawn.

    A score is the weight and a Gumbel deviate of the doc_id, so the highest scores are a draw without replacement in
    proportion to exp(weight / 1000). Null and empty texts have no feature and weight 0. Equal scores go to the
    smaller doc_id; rows that share it have ranks one after the other, those without one come last and share one deviate.
    An empty table gives no row, an empty target gains by the documents alone; other columns are not read. Very long texts
    and words count in full. Ranks need no global sort: the rows above a score are counted by score, of which there are
    fewer than some 200,000 at any size, as gains and deviates are logarithms; rows of one score are ranked by themselves.
    """
    w = weigh(docs, gains(docs, target, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = scratch(w.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long")), "scores")
    open_ = rows.where(F.col("n_words") >= least)
    by_score = open_.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score"))
    limit = F.floor(F.sum("n").over(Window.partitionBy()) * share / 100).cast("long")
    # One row for each score: the window is bounded as stated above.
    ahead = by_score.select("score", (F.sum("n").over(above) - F.col("n")).alias("ahead"), limit.alias("drawn")).where("ahead < drawn")
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features"))
    top = open_.join(F.broadcast(ahead), "score").withColumn("rank", F.col("ahead") + nth)
    drawn = F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank")
    rest = rows.join(F.broadcast(ahead.select("score", F.lit(True).alias("high"))), "score", "left").where((F.col("n_words") < least) | F.col("high").isNull())
    names = ["doc_id", "n_features", "weight", "score"]
    return top.select(*names, drawn).unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))
