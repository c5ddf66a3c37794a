"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import NO_ID, SALT, components, row_id, scratch, spread

#: Buckets up to this many fingerprints are compared pair by pair; in larger ones each looks up its possible neighbours.
PAIRWISE = 128


def word_grams(text: str | None, n: int) -> list[bytes]:
    """The text's shingles of n words (ASCII lower case); a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() and lower() know ASCII only
    if not words:
        return []
    return [b" ".join(g) for g in zip(*(words[i:] for i in range(n)), strict=False)] if len(words) >= n else [b" ".join(words)]


def majority(h: np.ndarray) -> int:
    """The bits that most of the hashes have; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for long texts
        part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of a text's word shingles (ASCII lower case); 0 without a word."""
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, seed) for g in word_grams(text, n)), np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, th, fp) for each row of docs; fp holds the 64 bits as a signed long, id the doc_id (null: the largest long), th a hash of the text."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp.view(np.int64))], ["id", "th", "fp"])

    return docs.select(row_id().alias("id"), text_hash().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, th long, fp long")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits such that any set of at most radius bits is disjoint from one of them.

    Bit i gets a nonzero vector v(i) over GF(2) of dimension radius+1; mask c holds the bits with <c, v(i)> = 1. The
    vectors of at most radius bits do not span the space, so some nonzero c is orthogonal to all of them.
    """
    space = (1 << radius + 1) - 1
    deal = np.random.default_rng(seed).permutation(64) % space + 1
    return [sum(1 << i for i in range(64) if bin(c & int(deal[i])).count("1") % 2) for c in range(1, space + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Pairs (a, b), each once or more, of ids whose fingerprints differ in 1 to radius bits. distinct: (fp, id), fp unique."""
    masks = covering_masks(radius)
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("k", "key"), "fp", "id")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = scratch(keyed.join(sizes, ["k", "key"]), "buckets")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    small = keyed.where(F.col("n") <= pairwise)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
    # In a large bucket the bits outside the mask are few: each fingerprint names every neighbour it can have there.
    flips = [[signed(sum(1 << b for b in c)) for r in range(1, radius + 1) for c in combinations([i for i in range(64) if not m >> i & 1], r)] for m in masks]
    spark: SparkSession = distinct.sparkSession
    table = spark.createDataFrame([(k, f) for k, fs in enumerate(flips) for f in fs], "k int, flip long")
    wide = keyed.where(F.col("n") > pairwise)
    asked = wide.select("k", F.col("fp"), "id").join(F.broadcast(table), "k").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("other"), "id", "fp").where(F.col("other") > F.col("fp")).select("other", F.col("id").alias("a"))
    looked = asked.join(distinct.select(F.col("fp").alias("other"), F.col("id").alias("b")), "other").select("a", "b")
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).union(looked)


def grouped(docs: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(id, th, fp, c, component_id) for each row of docs; equal fingerprints are one vertex, c names the component, and component_id is its smallest id."""
    prints = scratch(fingerprints(docs), "prints")
    distinct = scratch(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("id")), radius, pairwise))
    of = scratch(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "id", "n", F.coalesce("component", "fp").alias("c")), "named")
    low = scratch(of.groupBy("c").agg(F.min("id").alias("low"), F.count("*").alias("members")), "lowest")
    of, low = spread(of, low, ["c"], "members", ["fp"])
    of = of.join(low, ["c", SALT]).select("fp", "n", "c", F.when(F.col("low") < NO_ID, F.col("low")).alias("component_id"))
    prints, of = spread(prints, scratch(of, "groups"), ["fp"], "n", ["id", "th"])
    return prints.join(of, ["fp", SALT]).select("id", "th", "fp", "c", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Rows with equal fingerprints count as one vertex, so no group of copies is ever expanded into pairs. Null and
    empty texts have fingerprint zero and link like any other. Rows with a null doc_id sort last: their component_id
    is the smallest id that is not null, or null if there is none. Repeated rows get equal results; an empty table
    gives none. Columns besides doc_id and text are not read.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return grouped(docs, radius, pairwise).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of docs, all columns, of which one for each component: that of the smallest doc_id.

    A row is named by its doc_id and its text, so unrelated texts under one doc_id (or none) each answer for
    themselves. Rows without doc_id come last; of rows with one doc_id the one with the smaller hash of its text stays,
    and of rows that agree in both any one.
    """
    stay = grouped(docs, radius).groupBy("c").agg(F.min(F.struct("id", "th")).alias("s")).select(F.col("s.id").alias("__id"), F.col("s.th").alias("__th"))
    marked = docs.withColumns({"__id": row_id(), "__th": text_hash()}).join(stay, ["__id", "__th"], "left_semi")
    return marked.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__th").orderBy("text"))).where("__n = 1").select(*docs.columns)
