"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import components, scratch

#: Vectors that a cell should hold; rows of a block that is compared at once; pivots in all, which bounds what is broadcast.
CELL, BLOCK, PIVOTS = 2000, 4096, 4096
SIMILAR = 0.93


def usable(v):
    """Whether a vector can link: not null, not zero, every component finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0.0)


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(distinct: DataFrame, cell: int, limit: int) -> dict:
    """{(label, dim): unit vectors}: a sample by hash for each group larger than a cell, at most `limit` in all."""
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("m"))
    total = F.sum("m").over(Window.partitionBy())
    wanted = sizes.withColumn("k", F.least(F.ceil(F.col("m") / cell), F.floor(limit * F.col("m") / total))).where("k >= 2")
    share = F.col("k") / F.col("m")
    picked = distinct.join(F.broadcast(wanted.limit(limit)), ["label", "dim"]).where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * float(1 << 30)).select("label", "dim", "v")
    out: dict = {}
    for r in picked.limit(2 * limit).collect():
        out.setdefault((r["label"], r["dim"]), []).append(list(r["v"]))
    return {k: unit(sorted(v)) for k, v in out.items()}


def assign(distinct: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """Each vector in the cell of its nearest pivot, and in every lower cell that can hold a vector within radius.

    For x in cell i and y in cell j the plane halfway between p_i and p_j parts them, so |x - y| <= r needs that y is no
    farther than r from it: (d(y, p_i)^2 - d(y, p_j)^2) / (2 |p_i - p_j|) <= r. A pair across two cells is found in the
    lower one.
    """
    shipped = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            label, dim, vs = b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("v").to_pylist()
            at, cell, home = [], [], []
            groups: dict = {}
            for i, k in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(k, []).append(i)
            for k, rows in groups.items():
                p = shipped.value.get(k)
                if p is None:
                    at += rows
                    cell += [0] * len(rows)
                    home += [True] * len(rows)
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                for lo in range(0, len(rows), 1024):
                    part = np.array(rows[lo : lo + 1024])
                    d = np.maximum(2 - 2 * unit([vs[i] for i in part]) @ p.T, 0)  # squared
                    own = d.argmin(axis=1)
                    near = d - d[np.arange(len(part)), own][:, None] <= 2 * radius * apart[own] + 1e-6
                    near &= np.arange(len(p))[None, :] < own[:, None]
                    r, c = np.nonzero(near)
                    at += [*part.tolist(), *part[r].tolist()]
                    cell += [*own.tolist(), *c.tolist()]
                    home += [True] * len(part) + [False] * len(r)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("label", "dim", "rep", "n", "v")), pa.array(cell, pa.int32()), pa.array(home, pa.bool_())], ["label", "dim", "rep", "n", "v", "cell", "home"])

    return distinct.select("label", "dim", "rep", "n", "v").mapInArrow(run, "label long, dim int, rep long, n long, v array<double>, cell int, home boolean")


def compare(cut: float):
    """For the rows of one pair of blocks: how many vectors each links with, and the smallest rep it reaches here."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rep, n, home = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["home"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep, n, home, block = rep[order], n[order], home[order], pdf["block"].to_numpy()[order]
        x = unit([pdf["v"].iloc[i] for i in order])
        one, two = key[-2], key[-1]
        a = np.flatnonzero(block == one)
        b = a if one == two else np.flatnonzero(block == two)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        step = max(1, (1 << 21) // max(1, len(b)))
        for lo in range(0, len(a), step):
            rows = a[lo : lo + step]
            hit = x[rows] @ x[b].T >= cut
            hit &= home[rows][:, None] | home[b][None, :]
            if one == two:
                hit[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = False
                links[rows] += hit @ n[b]
            else:
                links[rows] += hit @ n[b]
                links[b] += n[rows] @ hit
            i, j = np.nonzero(hit)
            if len(i):
                pairs = np.unique(root[rows[i]] * len(rep) + root[b[j]])
                for p in pairs.tolist():
                    u, v = find(p // len(rep)), find(p % len(rep))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                while (root != root[root]).any():
                    root = root[root]
        got = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[got], "links": links[got], "low": rep[root[got]]})

    return run


def near_vectors(vectors: DataFrame, cut: float = SIMILAR, cell: int = CELL, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Vectors of one label link where their cosine, in double precision, is at least cut. Equal vectors are compared
    once and counted as often as they occur. Null, zero, empty and non-finite vectors and those with a null label link with nothing;
    vectors of different length neither. A cell larger than a block is compared block against block. Rows with a
    null vec_id take part; their ids stay null and they name a component only if nothing else does. Only these three
    columns are read.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.withColumn("id", F.coalesce("vec_id", F.lit(2**63 - 1)))
    good = base.where(usable(F.col("v")) & F.col("label").isNotNull()).withColumn("dim", F.size("v"))
    good = good.withColumn("v", F.transform("v", lambda x: x + 0.0))
    named = scratch(good.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "distinct")
    # The largest long stands for missing ids of several vectors: those get a name of their own.
    named = named.withColumn("rep", F.when(F.col("rep") == 2**63 - 1, F.lit(2**62) + F.pmod(F.xxhash64("label", "v"), F.lit(2**61))).otherwise(F.col("rep")))
    radius = math.sqrt(max(0.0, 2 - 2 * cut))
    entries = scratch(assign(named, pivots_of(named, cell, pivots), radius), "cells")
    place = ["label", "dim", "cell"]
    blocks = entries.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    entries = entries.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    entries = entries.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("k", "other")
    found = scratch(entries.groupBy(*place, "one", "two").applyInPandas(compare(cut), "rep long, links long, low long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    of = named.join(counts, "rep", "left").join(reach, named["rep"] == reach["node"], "left")
    of = of.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("low"))
    out = base.withColumn("v", F.transform("v", lambda x: x + 0.0)).join(of, ["label", "v"], "left")
    low = F.coalesce("low", "id")
    shown = F.when(low < 2**62, low)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), shown.alias("component_id"), F.coalesce(F.col("vec_id") == shown, F.lit(False)).alias("kept"))


#: The same over whole tables for DuckDB.
ORACLE = """
WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT vec_id, label, v FROM g WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
