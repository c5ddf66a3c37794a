"""What both exact dedups of repeated windows share: copies of whole texts, and which anchors occur more than once.

An anchor is a content-defined place: windows that are equal have the same anchor at the same distance. Only windows
whose anchor occurs twice or more need a closer look.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SALT, row_id, scratch, spread

#: Text bytes for each bucket of the exchange, and the fewest buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 64
PARTS = ("h", "th", "pos", "a", "b", "known")
KINDS = {"h": np.uint64, "th": np.int64, "pos": np.int64, "a": np.int32, "b": np.int32, "known": np.uint8}
PACKED = "bucket int, " + ", ".join(f"{p} binary" for p in PARTS)
LOOSE = "th long, h long, pos long, a int, b int"


def base_of(docs: DataFrame) -> DataFrame:
    """(doc_id, id, md5, th, text): null texts are empty; th, for the anchors, is made of the digest's first digits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(text.cast("binary"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), digest.alias("md5"), text.alias("text"))
    return plain.withColumn("th", F.xxhash64("md5"))


def statuses(base: DataFrame) -> DataFrame:
    """(id, md5, th, rep, copies, n): one row for each (id, text); rep is the smallest id with this text, copies its rows."""
    ids = base.select("id", "md5", "th", F.octet_length("text").alias("n")).groupBy("id", "md5", "th").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    ids = scratch(ids, "ids")
    whole = scratch(ids.groupBy("md5").agg(F.min("id").alias("rep"), F.sum("rows").alias("copies"), F.count("*").alias("ids")), "whole")
    ids, whole = spread(ids, whole, ["md5"], "ids", ["id"])
    return scratch(ids.join(whole, ["md5", SALT]).select("id", "md5", "th", "rep", "copies", "n"), "statuses")


def buckets_for(status: DataFrame) -> int:
    return max(BUCKETS, int((status.agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES) + 1)


def distinct_twice(h: np.ndarray, th: np.ndarray, pos: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor whether its h occurs at two distinct (th, pos) or is known to; and the first place of each h."""
    order = np.lexsort((pos, th, h))
    h2, th2, pos2 = h[order], th[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h2[1:] != h2[:-1]
    group = np.cumsum(new) - 1
    other = np.zeros(len(h), bool)
    other[1:] = ~new[1:] & ((th2[1:] != th2[:-1]) | (pos2[1:] != pos2[:-1]))
    twice = np.zeros(int(group[-1]) + 1 if len(h) else 0, bool)
    twice[group[other]] = True
    twice[group[known[order] > 0]] = True
    out, first = np.empty(len(h), bool), np.empty(len(h), bool)
    out[order], first[order] = twice[group], new
    return out, first


def pack(columns: dict[str, np.ndarray], buckets: int):
    """Record batch of one row for each bucket. Anchors that already repeat here go out at once (bucket -1), one of each stays."""
    again, first = distinct_twice(columns["h"], columns["th"], columns["pos"], np.zeros(len(columns["h"]), np.uint8))
    columns = columns | {"known": again.astype(np.uint8)}
    send = np.flatnonzero(~again | first)
    where = (columns["h"][send] % np.uint64(buckets)).astype(np.int64)
    send = send[np.argsort(where, kind="stable")]
    edges = np.searchsorted(np.sort(where), np.arange(buckets + 1))
    rows = [(k, send[edges[k] : edges[k + 1]]) for k in range(buckets) if edges[k] < edges[k + 1]]
    if again.any():
        rows.append((-1, np.flatnonzero(again)))
    arrays = [pa.array([k for k, _ in rows], pa.int32())]
    arrays += [pa.array([columns[p][i].astype(KINDS[p]).tobytes() for _, i in rows], pa.binary()) for p in PARTS]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *PARTS])


def detect(pdf: pd.DataFrame) -> pd.DataFrame:
    c = {p: np.frombuffer(b"".join(pdf[p]), KINDS[p]) for p in PARTS}
    again, _ = distinct_twice(c["h"], c["th"], c["pos"], c["known"])
    keep = again & (c["known"] == 0)
    return pd.DataFrame({"th": c["th"][keep], "h": c["h"][keep].view(np.int64), "pos": c["pos"][keep], "a": c["a"][keep], "b": c["b"][keep]})


def loosen(batches):
    for b in batches:
        for i in range(b.num_rows):
            c = {p: np.frombuffer(b.column(p)[i].as_py(), KINDS[p]) for p in PARTS}
            yield pa.RecordBatch.from_arrays([pa.array(c["th"]), pa.array(c["h"].view(np.int64)), pa.array(c["pos"]), pa.array(c["a"]), pa.array(c["b"])], ["th", "h", "pos", "a", "b"])


def repeated_anchors(base: DataFrame, anchors, buckets: int) -> DataFrame:
    """(th, anchors): for each text that has any, its anchors that occur elsewhere too.

    anchors(ths, texts) gives columns h, th, pos, a, b for a batch of texts. Copies of one text count once.
    """

    def run(batches):
        for b in batches:
            got = anchors(b.column("th").to_pylist(), b.column("text"))
            if len(got["h"]):
                yield pack(got, buckets)

    packed = scratch(base.select("th", "text").mapInArrow(run, PACKED), "anchors")
    found = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(detect, LOOSE)
    found = found.union(packed.where("bucket < 0").drop("bucket").mapInArrow(loosen, LOOSE))
    return found.groupBy("th").agg(F.collect_set(F.struct("pos", "a", "b", "h")).alias("anchors"))


def with_anchors(base: DataFrame, status: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, th, text, anchors): one document for each text with repeated anchors."""
    info = scratch(status.where("id = rep").join(anchors, "th").select("id", "md5", "anchors"), "places")
    return base.join(info, ["id", "md5"]).select("id", "th", "text", "anchors")


def with_spans(base: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, copy, copies, spans, text): found (id, th, lo, hi) are half-open ranges of window starts to act on.

    A text is named by id and th: null ids are one id, and an id may come with several texts. Only the row with the
    smallest id of a text has spans, so copies meet in no join.
    """
    spans = found.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    told = status.join(spans, ["id", "th"], "left").where("copies > 1 OR id <> rep OR spans IS NOT NULL")
    told = scratch(told.select("id", "md5", (F.col("id") != F.col("rep")).alias("copy"), "copies", "spans"), "spans")
    joined = base.join(told, ["id", "md5"], "left")
    return joined.select("doc_id", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "spans", "text")


def covered(n: int, spans, width: int) -> np.ndarray:
    """Which of n places lie in a window of `width` places that starts in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    for s in spans or ():
        steps[s["lo"]] += 1
        steps[min(n, s["hi"] - 1 + width)] -= 1
    return np.cumsum(steps)[:n] > 0
