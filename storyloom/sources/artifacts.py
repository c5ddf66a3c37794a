"""Directories of named files: ground truth of drafts and the files of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.tables import shared_path

ITEM = "array<struct<category:string,quote:string,truth:string,reason:string,established_in_chapters:array<int>>>"
TRUTH = f"draft string, note string, errors {ITEM}, hard_negatives {ITEM}, excluded {ITEM}, _corrupt string"


def own_name() -> Column:
    """The name of the file that a row comes from; Spark states it with its special characters as %XX."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name")


def put_named(rows: DataFrame, path: str) -> str:
    """Writes rows (name, body) as files of these names under path; a name that is there already is replaced.

    Tasks write the bodies, one file a name, and the driver only renames: as many renames as there are names.
    """
    spark = rows.sparkSession
    made = shared_path(spark, "named")
    rows.select("body", "name").repartition("name").write.partitionBy("name").option("lineSep", "\n").text(made)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(path))
    for folder in fs.listStatus(fs_path(made)):
        name = folder.getPath().getName()
        if not name.startswith("name="):
            continue
        part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
        target = fs_path(f"{path}/{spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[5:])}")
        fs.delete(target, False)
        fs.rename(part, target)
    return path


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(truths, broken): what the files {draft}.gt.json under path state.

    truths: (draft, kind, gid, quote, truth, category, chapters), kind being error, hard_negative or excluded; errors have the
    ids {draft}-GT1, 2, ... in their order. broken: (file_name) of files that are no such JSON.
    """
    read = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/*.gt.json")
    read = read.select("*", own_name())
    read = read.withColumn("draft", F.regexp_extract("file_name", r"^(.*)\.gt\.json$", 1))
    out = None
    for kind in ("errors", "hard_negatives", "excluded"):
        rows = read.where("_corrupt IS NULL").select("draft", F.posexplode(kind).alias("i", "x"))
        gid = F.concat("draft", F.lit("-GT"), (F.col("i") + 1).cast("string")) if kind == "errors" else F.lit(None).cast("string")
        rows = rows.select("draft", F.lit(kind.removesuffix("s")).alias("kind"), gid.alias("gid"), "x.quote", "x.truth", "x.category", F.col("x.established_in_chapters").alias("chapters"))
        out = rows if out is None else out.unionByName(rows)
    # Spark reads no file for the corrupt column alone.
    return out, read.where("_corrupt IS NOT NULL AND errors IS NULL").select("file_name")


def file_names(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file_name) of the files under path; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(own_name())


def complete_runs(spark: SparkSession, path: str, drafts: DataFrame) -> DataFrame:
    """(run): runs with a file claims_{run}_{draft}.json, and one evidence_{run}_{draft}.json for every draft (draft) asked for."""
    names = file_names(spark, path)
    parts = names.select(*[F.regexp_extract("file_name", r"^(claims|evidence)_([^_]+)_(.+)\.json$", i).alias(c) for i, c in ((1, "stage"), (2, "run"), (3, "draft"))]).where("stage <> ''")
    asked = drafts.select("draft").distinct()
    want = asked.agg(F.count("*").alias("want"))  # one row
    have = parts.where("stage = 'evidence'").join(asked, "draft", "left_semi").groupBy("run").agg(F.count_distinct("draft").alias("n"))
    return parts.where("stage = 'claims'").select("run").distinct().join(have, "run").crossJoin(F.broadcast(want)).where("n = want").select("run")
