"""Hierarchies, rewiring, neighbourhoods and rendered context of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.search import sized
from storyloom.sources.tables import kept


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor) along (src, dst), any number of steps; no node is its own ancestor.

    A round joins all pairs so far with themselves, so the length of the ways doubles and rounds grow with the logarithm
    of the depth. Each round is one table in the shared folder and reads only the one before. Cycles end, as pairs are distinct.
    """
    known = kept(edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).distinct(), "ancestors")
    n = known.count()
    while n:
        far = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        step = known.join(far, "ancestor").select("node", F.col("far").alias("ancestor")).where("node <> ancestor")
        known = kept(known.union(step).distinct(), "ancestors")
        before, n = n, known.count()
        if n == before:
            break
    return known


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that lie on a cycle of more than one edge."""
    up = ancestors(edges)
    back = edges.where("src <> dst").select(F.col("src").alias("ancestor"), F.col("dst").alias("node")).distinct()
    return up.join(back, ["ancestor", "node"], "left_semi").select("node").distinct()


def rewire(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges between canonical nodes: no loops, parallel edges once. canonical: (node_id, component)."""
    for end in ("src", "dst"):
        c = canonical.select(F.col("node_id").alias(end), F.col("component").alias("__c"))
        edges = edges.join(c, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    return edges.where("src <> dst").dropDuplicates(["src", "type", "dst"])


def induced(members: DataFrame, edges: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """(key, src, dst): edges with both ends among the members of a key. An edge goes to the keys of its source, then looks for its end there.

    A source that stands in more than one in `share` of all memberships, such as a country in every key, is hot. There
    are at most `share` of these; their edges meet the members where these are, if they are few enough to be broadcast.
    """
    own = kept(members.select(key, F.col("node").alias("src")).distinct(), "members")
    edges = edges.select("src", "dst").distinct()
    most = max(1000, own.count() // share)
    hot = kept(own.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src"), "hot")
    out = own.join(F.broadcast(hot), "src", "left_anti").join(edges.join(F.broadcast(hot), "src", "left_anti"), "src")
    out = out.unionByName(own.join(F.broadcast(hot), "src", "left_semi").join(sized(edges.join(F.broadcast(hot), "src", "left_semi")), "src"))
    return out.join(own.withColumnRenamed("src", "dst"), [key, "dst"], "left_semi").select(key, "src", "dst")
