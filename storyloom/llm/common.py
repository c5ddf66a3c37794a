"""What the operators of this package share: scratch tables, the packed exchange and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.tables import noted, shared_dir, swept

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the operators, so that such rows sort last.
NO_ID = 2**63 - 1
M64 = (1 << 64) - 1


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyloom/{uuid.uuid4().hex}-{name}"


def scratch(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: this cuts the lineage and outlives any executor. It goes with a block of sources.tables.passing, unless it stays."""
    path = noted(scratch_path(df.sparkSession, name), stays)
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SALT = "__salt"


def spread(big: DataFrame, small: DataFrame, key: list[str], n: str, by: list[str], least: int = 100, share: int = 10_000, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """big and small, to be joined on key and SALT such that a key of many rows of big is dealt out over tasks.

    small has one row for each key, is a stored table, and its column n says how many rows of big have this key. A key
    is hot if that is more than `least` and more than one in `share` of all; so there are at most `share` of them, which
    bounds what is broadcast. Rows of a hot key are dealt by a hash of the columns `by`; its row of small is repeated.
    """
    most = max(least, int((small.agg(F.sum(n)).first()[0] or 0) // share))
    hot = small.where(F.col(n) > most).select(*key, F.lit(True).alias("__hot"))
    dealt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col(n) > most, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return big.join(F.broadcast(hot), key, "left").withColumn(SALT, dealt).drop("__hot"), small.withColumn(SALT, F.explode(every))


def row_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit name for each pair (a, b): the finalizer of SplitMix64 over a linear form."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node that has a link.

    Large-star and small-star steps by turns; each round is a table in the shared folder, so a lost executor costs
    one round. Stars halve in depth, so rounds grow with the logarithm of a component's size.
    """
    step = scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        step = scratch(small, "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return step.select(F.col("a").alias("node"), F.col("b").alias("component")).union(step.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
