"""Stored vector cells: an index of vectors that requests read only where their nearest ones can lie; results are exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.search import BROADCAST_BYTES, Best, top_k, units, usable
from storyloom.sources.tables import exists, kept

#: Vectors that cells are laid out on, at most, and the number of cells for so many; vectors of no length lie in a cell of their own.
SAMPLE, VECTORS_A_CELL, MOST_CELLS, ROUNDS, ZERO = 20_000, 256, 2_048, 8, -1
TABLES = {"vectors": "node_id long, vec array<double>, chapter double, bundle int, cell int", "cells": "cell int, n long, radius double, bundle int", "centres": "cell int, vec array<double>"}


def laid_out(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors by some rounds of means; a cell that stays empty keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, units(np.where(n[:, None] > 0, total, c)), c)
    return c


class VectorCells:
    """Vectors of one length under a path, by the centre that they are nearest to, and each cell's radius.

    Centres are laid out once, on a sample of at most SAMPLE vectors, and only decide how much is read: every vector is
    stored and found. A bundle adds files; its table of cells is written last, and a bundle without it is not seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        return rows if name != "vectors" else rows.where(F.col("bundle") <= self.last())

    def last(self) -> int:
        return self.read("cells").agg(F.max("bundle")).first()[0] or 0

    def centres(self) -> np.ndarray:
        rows = sorted(self.read("centres").collect(), key=lambda r: r["cell"])  # at most MOST_CELLS
        return np.array([r["vec"] for r in rows])

    def _lay_out(self, rows: DataFrame) -> None:
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("node_id")).limit(SAMPLE).select("vec").toPandas()
        x = units(sample["vec"])
        c = laid_out(x[x.any(axis=1)], max(1, min(MOST_CELLS, n // VECTORS_A_CELL))) if x.any() else np.zeros((1, x.shape[1]))
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, vec array<double>").coalesce(1).write.parquet(f"{self.path}/centres")

    def add(self, vectors: DataFrame) -> int:
        """Adds vectors (node_id, vec[, chapter]) and returns the bundle's number. Vectors that are null, empty or not finite are left out."""
        chapter = (F.col("chapter") if "chapter" in vectors.columns else F.lit(None)).cast("double")
        rows = vectors.where(usable(F.col("vec"))).select(F.col("node_id").cast("long").alias("node_id"), F.col("vec").cast("array<double>").alias("vec"), chapter.alias("chapter"))
        if not exists(self.spark, f"{self.path}/centres"):
            if rows.isEmpty():
                return 0
            self._lay_out(rows)
        shipped, bundle = self.spark.sparkContext.broadcast(self.centres()), self.last() + 1
        size = shipped.value.shape[1]
        odd = rows.where(F.size("vec") != size).limit(1).count()
        if odd:
            raise ValueError(f"the cells hold vectors of {size} components")

        def placed(batches):
            c = shipped.value
            for pdf in batches:
                x = units(pdf["vec"])
                s = x @ c.T
                own = np.argmax(s, axis=1)
                away = np.sqrt(np.maximum(0, 2 - 2 * s[np.arange(len(x)), own]))
                zero = ~x.any(axis=1)
                yield pd.DataFrame({"node_id": pdf["node_id"], "vec": list(x), "chapter": pdf["chapter"], "away": np.where(zero, 0.0, away), "cell": np.where(zero, ZERO, own)})

        made = kept(rows.mapInPandas(placed, "node_id long, vec array<double>, chapter double, away double, cell int"), "placed")
        made.drop("away").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors/bundle={bundle}")
        made.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/bundle={bundle}")
        return bundle

    def _scored(self, ids: np.ndarray, q: np.ndarray, up_to: np.ndarray, pairs: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
        """The best k of each request among the cells that pairs (request x cell) name; only these cells' files are read."""
        wanted = {int(c): np.flatnonzero(pairs[:, i]) for i, c in enumerate(cells) if pairs[:, i].any()}
        shipped = self.spark.sparkContext.broadcast((ids, q, up_to, wanted))

        def score(batches):
            ids, q, up_to, wanted = shipped.value
            best: dict[int, Best] = {}
            for pdf in batches:
                for c, g in pdf.sort_values("node_id").groupby("cell"):
                    own = wanted[int(c)]
                    x = np.stack(list(g["vec"]))
                    s = q[own] @ x.T
                    s[g["chapter"].to_numpy(float)[None, :] >= up_to[own][:, None]] = -np.inf
                    best.setdefault(int(c), Best(len(own), k)).add(s, g["node_id"].to_numpy())
            for c, b in best.items():
                r, col = np.nonzero(b.score > -np.inf)
                yield pd.DataFrame({"query_id": ids[wanted[c]][r], "node_id": b.node[r, col], "score": b.score[r, col]})

        rows = self.read("vectors").where(F.col("cell").isin(list(wanted)) if wanted else F.lit(False)).select("node_id", "vec", "chapter", "cell")
        return rows.mapInPandas(score, "query_id long, node_id long, score double")

    def search(self, requests: DataFrame, k: int) -> DataFrame:
        """(query_id, node_id, score, rank) as vector_topk gives it. requests: (query_id, vec[, up_to]).

        A request first reads its nearest cells, until they hold k vectors. By the triangle inequality a vector is no nearer
        than the centre's distance less the cell's radius; so it then reads only cells that may hold one nearer than its k-th. Requests
        go in blocks of a checked size. `cells_read` and `cells_all` say how many cells requests read and might have read.
        """
        self.cells_read = self.cells_all = 0
        cell = self.read("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).toPandas().sort_values("cell")  # at most MOST_CELLS + 1
        empty = self.spark.createDataFrame([], "query_id long, node_id long, score double, rank int")
        if cell.empty:
            return empty
        c, cells = self.centres(), cell["cell"].to_numpy()
        up_to = (F.col("up_to") if "up_to" in requests.columns else F.lit(None)).cast("double")
        asked = requests.where(usable(F.col("vec"))).where(F.size("vec") == c.shape[1]).select("query_id", "vec", up_to.alias("up_to"))
        size = asked.select(F.sum(F.size("vec")) * 8).first()[0] or 0
        blocks, found = int(size // BROADCAST_BYTES) + 1, None
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()  # one block, of a checked size
            if part.empty:
                continue
            ids, q, limit = part["query_id"].to_numpy(), units(part["vec"]), part["up_to"].to_numpy(float)
            centre = np.where((cells == ZERO)[:, None], 0.0, c[np.maximum(cells, 0)])
            away = np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None, :] - 2 * q @ centre.T))
            near = np.maximum(0, away - cell["radius"].to_numpy()[None, :])
            bound = 1 - near**2 / 2
            bound[:, cells == ZERO] = 0.0
            bound[~q.any(axis=1)] = 0.0  # a request of no length has cosine 0 with all
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(cell["n"].to_numpy()[order], axis=1) - cell["n"].to_numpy()[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            one = kept(top_k(self._scored(ids, q, limit, first, cells, k), "query_id", [F.desc(F.round("score", 9)), F.asc("node_id")], k).drop("rank"), "near")
            kth = {r["query_id"]: r["s"] for r in one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}  # one row a request of this block
            floor = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
            more = ~first & (bound >= floor[:, None] - 1e-8)
            self.cells_read += int(first.sum() + more.sum())
            self.cells_all += first.size
            hits = one.union(self._scored(ids, q, limit, more, cells, k))
            found = hits if found is None else found.union(hits)
        return empty if found is None else top_k(found, "query_id", [F.desc(F.round("score", 9)), F.asc("node_id")], k)
