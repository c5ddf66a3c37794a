"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD, scratch
from storyloom.sources.tables import passing

#: Units that one flight takes at most, more or less: a source with more is dealt out over blocks.
BLOCK = 1024
#: The weights that sources get in turn, the words to take as a share of all, the most copies of a document.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target) from (source, size): share of all words, by weight, none above cap times its source.

    Works on one row for each source. With sources in the order of cap / weight, those before the first that stays
    below its cap are full; the rest share what is left by weight.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("full", F.col("source_size") * cap)
    run = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    by = by.withColumn("rest_w", F.sum("w").over(run.rowsBetween(0, Window.unboundedFollowing))).withColumn("before", F.coalesce(F.sum("full").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("rate", (share * F.sum("source_size").over(whole) - F.col("before")) / F.col("rest_w"))
    # From the first source below its cap on the rate only falls: that source has the largest.
    by = by.withColumn("rate", F.max(F.when(F.col("full") / F.col("w") > F.col("rate"), F.col("rate"))).over(whole))
    return by.select("source", "n", "source_size", F.coalesce(F.least("full", F.col("rate") * F.col("w")), F.col("full")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities along null vectors of the constraints (sum of sizes, number of units) until two or fewer are open.

    The vector is the projection onto the null space of the axis of the largest open unit that can move: the large settle first, at the
    expense of little from each of the others, and those left open are small. Each step settles one unit at least.
    """
    p = np.where(pi < 1e-9, 0.0, np.where(pi > 1 - 1e-9, 1.0, pi))
    at = np.flatnonzero((p > 0) & (p < 1))
    at = at[np.argsort(-size[at], kind="stable")]
    x = np.stack([size[at] / max(1.0, float(size.max(initial=0))), np.ones(len(at))], axis=1)
    q = p[at]
    while len(q):
        hat = x @ np.linalg.pinv(x.T @ x)
        free = 1 - (hat * x).sum(axis=1) > 1e-9  # the others can make up for a move of such a unit
        if not free.any():
            break  # as many open units as constraints
        lead = int(free.argmax())
        u = -(hat @ x[lead])
        u[lead] += 1
        up, down = np.full(len(q), np.inf), np.full(len(q), np.inf)
        rise, fall = u > 1e-12, u < -1e-12
        up[rise], down[rise] = (1 - q[rise]) / u[rise], q[rise] / u[rise]
        up[fall], down[fall] = -q[fall] / u[fall], (q[fall] - 1) / u[fall]
        far, back = up.min(), down.min()
        forward = rng.random() * (far + back) < back  # keeps each probability as the mean
        q = q + (far if forward else -back) * u
        q[(up if forward else down).argmin()] = np.round(q[(up if forward else down).argmin()])
        q = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
        p[at] = q
        open_ = (q > 0) & (q < 1)
        at, x, q = at[open_], x[open_], q[open_]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few open units go to 0 or 1 such that words, then units, come nearest to what their probabilities add up to."""
    at = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for bits in range(1 << len(at)):
        take = np.array([bits >> k & 1 for k in range(len(at))], float)
        off = (abs(((take - p[at]) * size[at]).sum()), abs((take - p[at]).sum()), bits)
        if best is None or off < best[0]:
            best = (off, take)
    out = p.copy()
    if len(at):
        out[at] = best[1]
    return out


def flier(last: bool, seed: int):
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(pdf["doc_id"].fillna(-1).to_numpy("int64"))
        pdf = pdf.assign(__o=order).sort_values(["__o", "doc_id", "size", "ordinal"], kind="stable", na_position="last").drop(columns=["__o", "b"])
        rng = np.random.default_rng([seed, int(key[1]), len(pdf)])
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["pi"].to_numpy(float), size, rng)
        return pdf.assign(pi=land(p, size) if last else p)

    return fly


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """doc_id, source, ordinal, size, source_size, target, copies (whole), taken (words), text_hash for each row of docs.

    A document is taken floor(target / source size) times and once more with the fraction as probability. Each flight
    balances words and documents of one block of one source; what it leaves open, two units at most, flies again with
    the rest of its source until one block is left, where at most two units of each source land. Null texts have size
    0; a null source is a source of its own, the last. Where one document holds a large part of its source, no choice may
    come nearer to the target than about half its size. Rows that agree in doc_id, source and size are told apart by
    ordinal, in the order of a hash of their text. An empty table gives no row. Only doc_id, text and source are read.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = scratch(sized, "sizes")
    goal = scratch(targets(sized, weights, share, cap), "targets")
    same = Window.partitionBy("doc_id", "source", "size").orderBy("text_hash")
    units = sized.withColumn("ordinal", F.row_number().over(same))
    units = units.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    units = units.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    units = units.withColumn("base", F.floor(F.col("ratio") + 1e-12)).withColumn("pi", F.greatest(F.lit(0.0), F.col("ratio") - F.col("base")))
    columns = "doc_id long, source string, size long, ordinal int, n long, source_size long, target double, ratio double, base long, pi double, text_hash long"
    most = goal.agg(F.max("n")).first()[0] or 0
    open_, done, last = units, [], False
    while not last:
        last = most <= block
        blocks = F.ceil(F.col("n") / block)
        dealt = open_.withColumn("b", F.pmod(F.xxhash64("doc_id", "ordinal", "size", F.lit(len(done))), blocks))

        flown = scratch(dealt.groupBy("source", "b").applyInPandas(flier(last, seed), columns), f"flight{len(done)}")
        settled = F.col("pi").isin(0.0, 1.0)
        done.append(flown if last else flown.where(settled))
        # At most two open units a block go on.
        open_ = flown.where(~settled).withColumn("n", 2 * blocks)
        most = 2 * -(-most // block)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("base") + F.col("pi").cast("long")).alias("copies")
    return out.select("doc_id", "source", "ordinal", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"), "text_hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it: a document taken twice gives two rows.

    The texts are exchanged once: rows are numbered after the join, by the columns of the join, none of which is null.
    """
    d, s = F.col("doc_id").cast("long"), F.col("source").cast("string")
    key = {"__d": F.coalesce(d, F.lit(0)), "__nd": d.isNull(), "__s": F.coalesce(s, F.lit("")), "__ns": s.isNull(), "__t": F.xxhash64("text")}
    # Rows of one text are alike, so what all of them take is dealt out among them: copies of one document differ by one at most.
    with passing(docs.sparkSession):
        plan = mix(docs, **options).withColumns({k: v for k, v in key.items() if k != "__t"}).withColumnRenamed("text_hash", "__t")
        plan = plan.groupBy(*key).agg(F.min("copies").alias("__least"), F.sum("copies").alias("__sum"), F.count("*").alias("__n"))
        plan = scratch(plan.where("__sum > 0"), "plan", stays=True)
    own = docs.withColumns(key).join(plan, [*key])
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__t"))
    took = own.withColumn("__copies", F.col("__least") + (number <= F.col("__sum") - F.col("__least") * F.col("__n")).cast("int")).where("__copies > 0")
    return took.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
