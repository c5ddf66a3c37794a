"""Aggregates over facts, evidence, verdicts and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import rules


def upper_median(name: str) -> Column:
    """The middle of a column's sorted values, the upper one of two; values are counted, not listed."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def listed(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): all values of a key in order, joined by commas. Equal values are counted first, so a key's list grows with its distinct values only."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").cast("int").alias("__n"))
    g = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(value, "__n"))).alias("__l"))
    return g.select(key, F.array_join(F.flatten(F.transform("__l", lambda x: F.array_repeat(x[value].cast("string"), x["__n"]))), ",").alias(out))


def merge_nodes(nodes: DataFrame, keys: list[str], combined: list[str], kept: list[str], order: str) -> DataFrame:
    """One row for each key: distinct values of `combined`, sorted; `kept` from the first node by `order`."""
    return nodes.groupBy(*keys).agg(F.min(order).alias("canonical"), F.count("*").alias("n"), *[F.array_sort(F.collect_set(c)).alias(c) for c in combined], *[F.min_by(c, order).alias(c) for c in kept])


def threshold_curve(scores: DataFrame, counted: dict[str, Column], score: str = "score") -> DataFrame:
    """tau from 0 to 10 and, for each name of `counted`, how many rows with at least this score its condition holds for.

    Scores are counted once; the eleven thresholds meet at most eleven counts.
    """
    counts = scores.groupBy(F.col(score).alias("s")).agg(*[F.count_if(c).alias(name) for name, c in counted.items()])
    taus = scores.sparkSession.range(11).select(F.col("id").cast("int").alias("tau"))
    hits = taus.join(F.broadcast(counts.where("s BETWEEN 0 AND 10")), F.col("s") >= F.col("tau"), "left")
    return hits.groupBy("tau").agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in counted])


def usage_rollup(usage: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Sums by keys with totals, null standing for all."""
    return usage.rollup(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def first_of(c: Column, order: Column, wanted: Column) -> Column:
    """The first value in order that is wanted."""
    return F.min_by(F.when(wanted, c), F.when(wanted, order))


def docstore_facts(hits: DataFrame) -> DataFrame:
    """One row for each fact from its hits in order of pos: name as first seen, first description and order there are, evidence and related names in order of first sight.

    hits: (node_id, pos, name, description, story_order, chunk_id, related). Repetitions are counted before lists are made.
    """
    filled = hits.groupBy("node_id").agg(F.min_by("name", "pos").alias("name"), first_of(F.col("description"), F.col("pos"), F.col("description") != "").alias("description"), first_of(F.col("story_order"), F.col("pos"), F.col("story_order").isNotNull()).alias("story_order"))

    def seen(column: str, out: str) -> DataFrame:
        first = hits.where(F.col(column).isNotNull()).groupBy("node_id", column).agg(F.min("pos").alias("pos"))
        return first.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]).alias(out))

    return filled.join(seen("chunk_id", "evidence"), "node_id", "left").join(seen("related", "related"), "node_id", "left")


def citation_hygiene(verdicts: DataFrame, key: str, tau: int) -> DataFrame:
    """Per key: citations that are not known, verdicts of tau or more that cite nothing, and known citations that the claim was not given. verdicts: (key, score, cited, known, given)."""
    off = F.array_except(F.array_intersect("cited", "known"), "given")
    return verdicts.groupBy(key).agg(F.sum(F.size(F.array_except("cited", "known"))).alias("unknown"), F.count_if((F.col("score") >= tau) & (F.size("cited") == 0)).alias("bare"), F.sum(F.size(off)).alias("off_reference"))


def verdict_audit(wanted: DataFrame, got: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: items wanted that are missing, and items that are extra."""
    w, g = wanted.select(key, item).distinct().withColumn("w", F.lit(1)), got.select(key, item).distinct().withColumn("g", F.lit(1))
    return w.join(g, [key, item], "full").groupBy(key).agg(F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"))


def alias_rank(keys: list[Column], partition: list[str], prefix: str, width: int) -> Column:
    """prefix and the rank by natural keys, at least width digits."""
    return F.format_string(f"{prefix}%0{width}d", F.row_number().over(Window.partitionBy(*partition).orderBy(*keys)))


def cost_columns(prompt: Column, cached: Column, completion: Column) -> list[Column]:
    return [F.round(rules.cost(prompt, cached, completion), 9).alias("cost"), F.round(rules.cold_cost(prompt, completion), 9).alias("cold_cost")]
