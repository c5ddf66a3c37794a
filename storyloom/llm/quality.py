"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import scratch

#: Random features, width of the kernel, ridge penalty, folds, calibration bins.
FEATURES, SIGMA, RIDGE, FOLDS, BINS = 256, 4.0, 1.0, 4, 2000
#: From this score on a document counts as good.
ACCEPT = 0.7
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"-", "shout": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@^~/\\_{}[]()`"}
_class_table = np.zeros((256, len(CLASSES) + 1))
for _k, _members in enumerate(CLASSES.values()):
    _class_table[list(_members), _k] = 1
_class_table[128:, -1] = 1


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text: sizes, kinds of characters, variety of words and lines, compressibility."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * 16
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / m,
        *(counts @ _class_table / n).tolist(),
        len(set(words)) / m, math.log1p(len(lines)), math.log1p(m / len(lines)), len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / (n + 32), float(-(share * np.log2(share)).sum()),
    ]


def statistics_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs; a null text counts as an empty one."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.lift(x) @ self.beta, self.knots, self.values), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x; returns knots and values of the step means, joined by lines."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, weight, strict=True):
        pools.append([a * c, b * c, c, a, a])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            t = pools.pop()
            pools[-1] = [pools[-1][0] + t[0], pools[-1][1] + t[1], pools[-1][2] + t[2], pools[-1][3], t[4]]
    knots, values = [], []
    for _, sy, w, lo, hi in pools:
        for k in dict.fromkeys((lo, hi)):
            knots.append(k)
            values.append(sy / w)
    return np.array(knots), np.array(values)


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES, sigma: float = SIGMA, ridge: float = RIDGE, seed: int = 42) -> Model:
    """Fits on every labelled row of (doc_id, x) outside the held-out quarter.

    Each task sums its own normal equations, by fold; Spark adds them up row by row of the matrix, so the driver gets
    one matrix for each fold, of a fixed size. The scores that the other folds give a row calibrate the model: Spark
    counts them in a fixed number of bins.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    train = rows.join(marks, "doc_id").where(~held_out(F.col("doc_id"))).select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    train = scratch(train, "train")
    d = len(statistics(""))
    moments = train.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").toPandas()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(d, features)) / sigma, rng.uniform(0, 2 * math.pi, features)
    if moments.empty:
        return Model(np.zeros(d), np.ones(d), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    model = Model(moments["m"].to_numpy(), np.maximum(moments["s"].to_numpy(), 1e-6), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    shipped = docs_context(rows).broadcast(model)

    def equations(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = np.array(batch.column("x").to_pylist()), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for lo in range(0, len(y), 2048):
                z, part = shipped.value.lift(x[lo : lo + 2048]), fold[lo : lo + 2048]
                zy = np.hstack([z, y[lo : lo + 2048, None]])
                for f in np.unique(part):
                    sums[int(f)] = sums.get(int(f), 0) + z[part == f].T @ zy[part == f]
        for f, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(a), pa.int32()), pa.array(range(len(a)), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], ["fold", "i", "a"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "a": [np.sum(np.stack(pdf["a"].to_numpy()), axis=0)]})

    summed = train.mapInArrow(equations, "fold int, i int, a array<double>").groupBy("fold", "i").applyInPandas(add, "fold int, i int, a array<double>").toPandas()
    systems = [np.stack(g.sort_values("i")["a"].to_numpy()) for _, g in summed.groupby("fold")]
    folds = sorted(summed["fold"].unique())
    whole = np.sum(systems, axis=0)

    def solve(a: np.ndarray) -> np.ndarray:
        penalty = ridge * np.eye(len(a))
        penalty[-1, -1] = 1e-6
        return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    model.beta = solve(whole)
    others = {int(f): solve(whole - a) if len(folds) > 1 else model.beta for f, a in zip(folds, systems, strict=True)}
    apart = docs_context(rows).broadcast((model, others))

    def binned(batches):
        counts = np.zeros((BINS, 3))
        for batch in batches:
            m, by_fold = apart.value
            x, y, fold = np.array(batch.column("x").to_pylist()), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for lo in range(0, len(y), 2048):
                z, part = m.lift(x[lo : lo + 2048]), fold[lo : lo + 2048]
                raw = np.einsum("ij,ij->i", z, np.stack([by_fold[int(f)] for f in part]))
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                np.add.at(counts, at, np.stack([raw, y[lo : lo + 2048], np.ones(len(part))], axis=1))
        at = np.flatnonzero(counts[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(counts[at, k], pa.float64()) for k in range(3))], ["bin", "raw", "y", "n"])

    bins = train.mapInArrow(binned, "bin int, raw double, y double, n double").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    model.knots, model.values = isotonic(bins["raw"] / bins["n"], bins["y"] / bins["n"], bins["n"])
    return model


def docs_context(df: DataFrame):
    return df.sparkSession.sparkContext


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted from (doc_id, x)."""
    shipped = docs_context(rows).broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            s = np.concatenate([shipped.value.score(x[lo : lo + 2048]) for lo in range(0, b.num_rows, 2048)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Statistics come from the text alone. Null and empty texts have the same score. Labels that are null, or of
    documents that are not there, are not used; a document with several labels has the largest. Repeated rows get
    equal rows; without any label every score is 0.5. Columns besides doc_id and text are not read.
    """
    rows = scratch(statistics_rows(docs), "statistics")
    return score_rows(rows, fit(rows, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with a score of at least 0.7; texts pass through once, without a shuffle."""
    shipped = docs_context(docs).broadcast(fit(statistics_rows(docs), labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = shipped.value.score(np.array([statistics(t.as_py()) for t in b.column(at)]))
                yield b.filter(pa.array(s >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
