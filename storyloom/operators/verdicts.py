"""From model replies to findings: parsed, voted, cut at the threshold, with lines and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import rules
from storyloom.operators.aggregates import upper_median
from storyloom.operators.joins import resolve_cited
from storyloom.sources.tables import kept


def parse_verdicts(replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, problems) of replies (keys, raw), raw being JSON.

    verdicts: (keys, claim_index from 0, score from 0 to 10, picked, cited, reason, flags); of several for one claim in a
    reply the last one holds. problems: (keys, problem) for what is no JSON and for verdicts without a number.
    """
    read = replies.select(*keys, F.from_json("raw", rules.VERDICTS).alias("j"))
    # Broken JSON gives a null struct or one of nulls, by Spark's parser mode.
    broken = read.where("j IS NULL OR j.verdicts IS NULL").select(*keys, F.lit("json_parse_failed").alias("problem"))
    v = read.select(*keys, F.posexplode("j.verdicts").alias("pos", "v"))
    score, flags = rules.clamp_score(F.col("v.score"))
    unknown = F.when(F.col("v.claimId").isNotNull() & ~F.col("v.claimId").rlike("^P[0-9]+$"), F.lit("claim_id_unknown"))
    none = F.array().cast("array<string>")
    v = v.select(*keys, "pos", rules.claim_index(F.col("v.claimId"), F.col("v.i")).alias("claim_index"), score.alias("score"), F.col("v.lineIds").alias("picked"), F.coalesce("v.cited", none).alias("cited"), F.coalesce("v.reason", F.lit("")).alias("reason"), F.array_compact(F.concat(F.array(unknown), flags)).alias("flags"))
    problems = broken.unionByName(v.where("claim_index IS NULL").select(*keys, F.lit("bad_index").alias("problem")))
    later = F.row_number().over(Window.partitionBy(*keys, "claim_index").orderBy(F.desc("pos")))
    return v.where("claim_index IS NOT NULL").withColumn("__r", later).where("__r = 1").drop("__r", "pos"), problems


def findings(claims: DataFrame, replies: DataFrame, sources: DataFrame, tau: int = rules.TAU) -> DataFrame:
    """(job, claim_id, n, score, lines, cited): claims whose voted score reaches tau, in every job.

    claims (job, n from 1, lines, candidate numbers); replies (job, sample, batch, raw); sources (job, alias, chunk_id,
    chapter, idx). A claim's score is the upper middle of its samples' scores. Lines and citations are those of its first sample; lines
    that are no candidates fall back to all candidates, citations turn into chunks in their order, unknown ones go.
    """
    v, _ = parse_verdicts(replies, ["job", "sample", "batch"])
    votes = v.groupBy("job", (F.col("claim_index") + 1).alias("n")).agg(upper_median("score").cast("int").alias("score"), F.min_by("picked", F.struct("sample", "batch")).alias("picked"), F.min_by("cited", F.struct("sample", "batch")).alias("cited"))
    met = votes.where(F.col("score") >= tau).join(claims.select("job", "n", F.col("lines").alias("candidates")), ["job", "n"])
    lines, _ = rules.picked_lines(F.col("picked"), F.coalesce("candidates", F.array().cast("array<int>")))
    met = kept(met.select("job", "n", "score", lines.alias("lines"), "cited"), "findings")
    own = F.concat_ws("\x01", "job", "n")
    aliases = sources.select(F.concat_ws("\x01", "job", "alias").alias("alias"), "chunk_id", "chapter", "idx")
    asked = met.select(own.alias("claim_id"), F.transform("cited", lambda a: F.concat_ws("\x01", "job", a)).alias("cited"))
    places = resolve_cited(asked, aliases).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    out = met.withColumn("claim_id", own).join(places, "claim_id", "left")
    return out.select("job", F.concat(F.lit("P"), "n").alias("claim_id"), "n", "score", "lines", "chunks")
