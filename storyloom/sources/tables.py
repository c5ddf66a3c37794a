"""Tables of the narrative model in files: idempotent writes by partition, upserts and markers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one, on a local master only: elsewhere tasks would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-storyloom-")
    return _own[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyloom/{uuid.uuid4().hex}-{name}"


#: Spark's setting by which a query's shuffle files go when it ends. It holds for what is written, as nobody reads that plan again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what is written inside go as each write ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Paths of the tables that go at the end of the innermost block of passing().
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession):
    """Tables that kept() writes inside go when the block ends, so nothing that reads them may be left then but what was kept with stays."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def noted(path: str, stays: bool = False) -> str:
    """path, which goes with the block of passing() that is open, if any, unless it stays."""
    if not stays and _passing.get() is not None:
        _passing.get().append(path)
    return path


def kept(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing before it."""
    path = noted(shared_path(df.sparkSession, name), stays)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_partitions(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Replaces exactly the partitions that df has; writing the same rows twice leaves the same table."""
    # A rebalance deals a large work over several tasks and joins small ones.
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.parquet(path)


def put_keys(df: DataFrame, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 32) -> DataFrame:
    """Replaces the rows of exactly the keys that df has, and leaves all others.

    The table is partitioned by `by` and a bucket of the keys, so a write reads and writes the partitions of its keys
    only, however many keys the table holds. What stays in those goes through the shared folder, as Spark cannot read
    what it overwrites. Writing the same rows twice leaves the same table; a job that fails leaves the old one.
    """
    spark, parts = df.sparkSession, [*(by or []), "bucket"]
    new = kept(df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "new")
    rows = new
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        stays = old.join(new.select(*parts).distinct(), parts, "left_semi").join(new.select(*keys).distinct(), keys, "left_anti")
        rows = new.unionByName(kept(stays, "stays"))
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def put_latest(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 32) -> DataFrame:
    """Keeps the last row of each key by `order`, of those that are there and those of df; a write touches the buckets of its keys only. Writing rows again changes nothing."""
    spark = df.sparkSession
    new = kept(df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "new")
    rows = new
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        rows = new.unionByName(kept(old.join(new.select("bucket").distinct(), "bucket", "left_semi"), "old"))
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("bucket", *keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    last.select(*new.columns).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new, and the rows of old whose keys it doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under path, on whatever store Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def put_report(rows: DataFrame, path: str, *columns: str) -> DataFrame:
    """rows, of which there are few, as one JSON file and one Markdown file of table lines under path; returns the lines."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    read = rows.sparkSession.read.schema(rows.schema).json(f"{path}/json")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    read.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")).coalesce(1).write.mode("overwrite").text(f"{path}/md")
    return rows.sparkSession.read.text(f"{path}/md").withColumnRenamed("value", "line")


def stamped(df: DataFrame, tenant) -> DataFrame:
    """df with its tenant in the same write; rows without one fail the job."""
    return df.withColumn("tenant_id", F.coalesce(tenant, F.raise_error(F.lit("a row has no tenant"))))
