"""Line dedup over content-defined chunks, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SALT, row_id, scratch, spread

#: A boundary stands after one line in so many; the modulus and factor of a Lehmer generator, which mixes window hashes.
DIVISOR, PRIME, FACTOR = 2, 2147483647, 48271


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column of its own step: what a lambda refers to is then computed once a row, not once an element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunked(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs without text, with __null, __id, __th (a hash of the text), __lines and __chunks: arrays of (at, n), half of which overlap.

    The rolling hash of a line is that of the line before and its own; after a mixing step it decides whether the line
    is a boundary, so that a boundary depends on two lines only and an insertion moves none further on. A chunk is
    the two lines of a boundary, or reaches from one boundary's two lines to the next one's (from the first line, to
    the last line, at the ends).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    base = docs.select(*[docs[c] for c in rest], F.col("text").isNull().alias("__null"), row_id().alias("__id"), F.xxhash64(text).alias("__th"), F.explode(F.array(F.split(text, "\n", -1))).alias("__lines"))
    base = once(base, "__h", F.transform("__lines", line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("__h", 1, F.size("__h") - 1))
    rolled = F.zip_with("__h", before, lambda h, b: F.shiftright((b * 31 + h) % PRIME * FACTOR % PRIME, 12) % divisor)
    base = once(base, "__ends", F.filter(F.transform(rolled, lambda r, i: F.when((r == 0) & (i > 0), i)), lambda e: e.isNotNull()))
    last, none = F.size("__lines") - 1, F.size("__ends") == 0
    starts = F.concat(F.array(F.lit(0)), F.transform("__ends", lambda e: e - 1))
    spans = F.zip_with(starts, F.concat("__ends", F.array(last)), lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))
    pairs = F.transform("__ends", lambda e: F.struct((e - 1).alias("at"), F.lit(2).alias("n")))
    chunks = F.concat(pairs, F.filter(spans, lambda s: (s["n"] > 2) | none))
    return base.select(*rest, "__null", "__id", "__th", "__lines", chunks.alias("__chunks"))


def candidates(base: DataFrame, min_lines: int = 2) -> DataFrame:
    """(__id, __th, __cand): for each document that has any, its chunks (at, n, h) whose hash occurs more than once.

    Hashes and places alone are exchanged, no bytes. Chunks of fewer than min_lines lines, or without a character, are
    none. Chunks that occur often are dealt out over tasks.
    """
    places = base.select("__id", "__th", "__lines", F.explode("__chunks").alias("__c")).where(F.col("__c.n") >= min_lines)
    places = places.select("__id", "__th", "__c", chunk_text("__c").alias("chunk")).where(F.length(F.translate("chunk", "\n", "")) > 0)
    places = scratch(places.select("__id", "__th", F.struct("__c.at", "__c.n", F.xxhash64("chunk").alias("h")).alias("__c")).withColumn("h", F.col("__c.h")), "places")
    twice = scratch(places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "twice")
    dealt, twice = spread(places, twice, ["h"], "times", ["__id", "__th", "__c"])
    return dealt.join(twice.select("h", SALT), ["h", SALT], "left_semi").groupBy("__id", "__th").agg(F.collect_set("__c").alias("__cand"))


def chunk_text(c: str) -> Column:
    return F.array_join(F.slice("__lines", F.col(f"{c}.at") + 1, F.col(f"{c}.n")), "\n")


def repeated(told: DataFrame) -> DataFrame:
    """(__id, __th, __gone): for each document the candidates that occur earlier, byte for byte, by doc_id and position."""
    found = told.select("__id", "__th", "__lines", F.explode("__cand").alias("__c")).select("__id", "__th", "__c", F.col("__c.h").alias("h"), chunk_text("__c").alias("chunk"))
    first = scratch(found.groupBy("h", "chunk").agg(F.min(F.struct("__id", "__th", "__c")).alias("first"), F.count("*").alias("times")).where("times > 1"), "first")
    dealt, first = spread(found, first, ["h", "chunk"], "times", ["__id", "__th", "__c"])
    later = dealt.join(first, ["h", "chunk", SALT]).where(F.struct("__id", "__th", "__c") != F.col("first"))
    return later.groupBy("__id", "__th").agg(F.collect_set("__c").alias("__gone"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = 2) -> DataFrame:
    """docs, all columns and rows, with text cut to what stays, and __n_lines, __n_removed.

    A line goes if a chunk of at least min_lines lines covers it that also occurs earlier, by (doc_id, position);
    chunks are judged on the input. A null text counts as empty and stays null. Rows that agree in doc_id and text are
    one document and get the same result; rows without doc_id come last. A document all of whose lines go keeps its
    row with an empty text. A very long text is one row, handled in time linear in its lines. Columns may have any
    name that doesn't begin with two underscores.
    """
    base = chunked(docs, divisor)
    named = lambda df: df.withColumnsRenamed({"__id": "__i", "__th": "__t"})
    same = (F.col("__id") == F.col("__i")) & (F.col("__th") == F.col("__t"))
    told = scratch(base.drop("__chunks").join(named(candidates(base, min_lines)), same, "left").drop("__i", "__t"), "told")
    some = told.where(F.col("__cand").isNotNull())
    marked = some.join(named(repeated(some)), same, "left").drop("__i", "__t", "__cand")
    marked = marked.unionByName(told.where(F.col("__cand").isNull()).drop("__cand"), allowMissingColumns=True)
    every, covered = F.sequence(F.lit(0), F.size("__lines") - 1), F.flatten(F.transform("__gone", lambda c: F.sequence(c["at"], c["at"] + c["n"] - 1)))
    marked = once(marked, "__kept", F.when(F.col("__gone").isNull(), every).otherwise(F.array_except(every, covered)))
    whole = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    out = marked.withColumns({
        "__n_lines": F.size("__lines").cast("long"),
        "__n_removed": (F.size("__lines") - F.size("__kept")).cast("long"),
        "text": F.when(~F.col("__null"), whole),
    })
    return out.select(*docs.columns, "__n_lines", "__n_removed")


#: The same over whole tables for DuckDB.
ORACLE = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM l),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls)), lambda i: (((hs[i] * 31 + hs[i + 1]) % {PRIME} * {FACTOR} % {PRIME}) >> 12) % {DIVISOR} = 0) AS es FROM h),
s AS (SELECT doc_id, ls, unnest(es) - 1 AS lo, unnest(es) AS hi FROM e
  UNION SELECT doc_id, ls, unnest(list_concat([0], list_transform(es, lambda x: x - 1))) AS lo, unnest(list_concat(es, [len(ls) - 1])) AS hi FROM e),
c AS (SELECT DISTINCT doc_id, lo, hi, array_to_string(ls[lo + 1:hi + 1], chr(10)) AS chunk FROM s WHERE hi > lo),
g AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, lo) AS r FROM c WHERE length(replace(chunk, chr(10), '')) > 0) WHERE r > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM g),
a AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
k AS (SELECT a.doc_id, a.i, a.line, x.i IS NOT NULL AS gone FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.i = a.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
