"""Normal forms, names, aliases, lines, chunks and markers of text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Punctuation that comparisons of quotes ignore, and characters that names may differ in.
PUNCTUATION = r"""[『』「」\"'“”‘’·,.!?…\-—\[\]()<>《》〈〉:;/]"""
NAME_NOISE = r"""[\s<>《》「」『』【】()\[\]“”‘’"']"""
#: White space including the ideographic and the no-break space, alike in Java and RE2.
BLANK = r"[\s\x{3000}\x{00A0}]+"
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"


def norm(c: Column) -> Column:
    """Without any white space; null gives an empty string."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, "")


def loose(c: Column) -> Column:
    """A normal form without punctuation."""
    return F.regexp_replace(norm(c), PUNCTUATION, "")


def name_key(c: Column) -> Column:
    """What decides whether two names are written alike; null where nothing is left."""
    key = F.regexp_replace(c, NAME_NOISE, "")
    return F.when(key != "", key)


def alias_flatten(c: Column) -> Column:
    """Trimmed aliases from elements that may hold several, parted by commas."""
    parts = F.flatten(F.transform(c, lambda x: F.split(x, ",")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def evidence_tokens(c: Column) -> Column:
    """'C3, C4' to [3, 4]; tokens of another form, or beyond an int, go."""
    tokens = F.transform(F.split(c, ","), lambda x: F.trim(x))
    digits = F.transform(F.filter(tokens, lambda x: x.rlike("^C[0-9]+$")), lambda x: F.regexp_replace(x, "^C0*(?=[0-9])", ""))
    return F.filter(F.transform(digits, lambda x: x.try_cast("int")), lambda n: n.isNotNull())


def sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({SENTENCE})"))


def line_parts(c: Column, max_len: int = 200) -> Column:
    """Lines of a text: its sentences, cut at line feeds and trimmed, in pieces of max_len at most."""
    cut = F.flatten(F.transform(sentences(c), lambda s: F.split(s, "\n")))
    trimmed = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
    pieces = F.transform(trimmed, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_len).cast("int")), lambda k: F.substring(s, k * max_len + 1, F.lit(max_len))))
    return F.flatten(pieces)


def split_oversized(start: Column, end: Column, size: int) -> Column:
    """[start, end) as spans of at most size."""
    return F.transform(F.sequence(start, end - 1, F.lit(size).cast("long")), lambda i: F.struct(i.alias("start"), F.least(i + size, end).alias("end")))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
NUMBERS = T.ArrayType(T.IntegerType())
EDGES = " \t\n\r"


def _listed(rows: list, kind: T.ArrayType) -> pa.Array:
    """Lists of spans, or of numbers, as an Arrow array; None stays null."""
    known = [r or () for r in rows]
    flat = [x for r in known for x in r]
    values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1)], ["start", "end"]) if kind == SPANS else pa.array(flat, pa.int32())
    ends = list(accumulate(map(len, known), initial=0))
    offsets = pa.array([None if i < len(rows) and rows[i] is None else e for i, e in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def _pairs(spans: list | None) -> list[tuple[int, int]] | None:
    return None if spans is None else [(s["start"], s["end"]) for s in spans]


def places(parts: list[str]) -> list[tuple[int, int]]:
    """Spans of the parts of a text without white space at their ends; the parts are the whole text, so lengths add up to places."""
    out, at = [], 0
    for s in parts:
        body = s.strip(EDGES)
        if body:
            start = at + len(s) - len(s.lstrip(EDGES))
            out.append((start, start + len(body)))
        at += len(s)
    return out


def packed(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Consecutive spans joined while they stay within size; longer ones are cut to size first."""
    out: list[list[int]] = []
    for s, e in spans:
        for i in range(s, e, size):
            end = min(i + size, e)
            if out and end - out[-1][0] <= size:
                out[-1][1] = end
            else:
                out.append([i, end])
    return [(s, e) for s, e in out]


# One pass over each text: a fold over an array column would copy what it has at every step.


@F.arrow_udf(SPANS)
def sentence_spans(parts: pa.Array) -> pa.Array:
    """places of the parts of each text."""
    return _listed([None if p is None else places(p) for p in parts.to_pylist()], SPANS)


@F.arrow_udf(SPANS)
def located_spans(text: pa.Array, parts: pa.Array) -> pa.Array:
    """Spans of sentences that somebody else cut: each is looked up after the one before it; those that are not there are left out."""
    out = []
    for t, sentences_ in zip(text.to_pylist(), parts.to_pylist(), strict=True):
        if t is None or sentences_ is None:
            out.append(None)
            continue
        spans, at = [], 0
        for s in sentences_:
            body = (s or "").strip(EDGES)
            start = t.find(body, at) if body else -1
            if start >= 0:
                at = start + len(body)
                spans.append((start, at))
        out.append(spans)
    return _listed(out, SPANS)


@F.arrow_udf(SPANS)
def _packed(spans: pa.Array, size: pa.Array) -> pa.Array:
    return _listed([None if s is None else packed(_pairs(s), n) for s, n in zip(spans.to_pylist(), size.to_pylist(), strict=True)], SPANS)


def pack_spans(spans: Column, size: int = 100) -> Column:
    """packed spans of each text."""
    return _packed(spans, F.lit(size))


@F.arrow_udf(SPANS)
def chunk_spans(text: pa.Array, size: pa.Array) -> pa.Array:
    """Sentences of each text, packed into chunks of at most size characters."""
    cut = re.compile(SENTENCE)
    return _listed([None if t is None else packed(places(cut.findall(t)), n) for t, n in zip(text.to_pylist(), size.to_pylist(), strict=True)], SPANS)


def overlapping_chunks(spans: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of at most size that may start with the last spans of the chunk before, up to overlap characters of them.

    Ends rise, so a chunk's last span is found by bisection; running lengths give the first span that a chunk repeats.
    A repetition that leaves no room for the next span is dropped.
    """
    cut = [(i, min(i + size, e)) for s, e in spans for i in range(s, e, size)]
    starts, ends = [s for s, _ in cut], [e for _, e in cut]
    lengths = list(accumulate((e - s for s, e in cut), initial=0))
    out, head = [], 0
    while head < len(cut):
        after = bisect_right(ends, starts[head] + size, head)
        out.append((starts[head], ends[after - 1]))
        if after == len(cut):
            break
        repeat = max(head, bisect_left(lengths, lengths[after] - overlap, head, after))
        head = repeat if ends[after] - starts[repeat] <= size else after
    return out


class PackChunks:
    """Table function (text, size, overlap) to rows of chunk_index, start, stop, chunk_text."""

    def eval(self, text: str, size: int, overlap: int):
        text = text or ""
        bodies = ((m.start() + len(m.group()) - len(m.group().lstrip(EDGES)), m.group().strip(EDGES)) for m in re.finditer(SENTENCE, text))
        for i, (s, e) in enumerate(overlapping_chunks([(at, at + len(body)) for at, body in bodies if body], size, overlap)):
            yield i, s, e, text[s:e]


def register_pack_chunks(spark) -> None:
    spark.udtf.register("pack_chunks", F.udtf(PackChunks, returnType="chunk_index int, start int, stop int, chunk_text string"))


def lines_of(text: str, max_len: int = 200) -> list[str]:
    """What line_parts gives, for one text."""
    trimmed = (part.strip(" ") for s in re.findall(SENTENCE, text) for part in s.split("\n"))
    return [t[i : i + max_len] for t in trimmed for i in range(0, len(t), max_len)]


@F.arrow_udf(NUMBERS)
def _pieces(text: pa.Array, size: pa.Array) -> pa.Array:
    out = []
    for own, most in zip(text.to_pylist(), size.to_pylist(), strict=True):
        numbers, held, piece = [], 0, 1
        for i, line in enumerate(lines_of(own or ""), 1):
            n = len(line) + len(f"L{i}: ")
            if held and held + n > most:
                piece, held = piece + 1, 0
            held += n
            numbers.append(piece)
        out.append(numbers)
    return _listed(out, NUMBERS)


def pack_pieces(text: Column, size: int = 3000) -> Column:
    """For each numbered line of a text the number of its piece, from 1: a piece closes before the line that would pass size."""
    return _pieces(text, F.lit(size))


def claim_cap(n: Column) -> Column:
    """Most claims to take from a piece of n characters."""
    return F.greatest(F.lit(20), F.floor(n / 30)).cast("int")


def parse_duration(c: Column) -> Column:
    """'6m0s', '500ms' to seconds; null where nothing fits."""
    number, unit = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.][0-9]+)?)(ms|h|m|s)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.][0-9]+)?)(ms|h|m|s)"), F.lit(2))
    factor = F.create_map(*[F.lit(x) for x in ("h", 3600.0, "m", 60.0, "s", 1.0, "ms", 0.001)])
    seconds = F.aggregate(F.zip_with(number, unit, lambda a, u: a.cast("double") * factor[u]), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(number) > 0, seconds)


def short_label(c: Column, n: int = 24) -> Column:
    """Spaces squeezed, cut to n characters and an ellipsis."""
    one = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("…"))).otherwise(one)


def trigrams(c: Column) -> Column:
    n = norm(c)
    return F.when(F.length(n) < 3, F.array(n)).otherwise(F.array_distinct(F.regexp_extract_all(n, F.lit("(?s)(?=(.{3}))"), F.lit(1))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of trigrams."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def name_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer name."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two columns of vectors, a batch at a time; 0 where one is zero, null where one is null."""
    ok = a.notna() & b.notna()
    out = pd.Series([None] * len(a), dtype="float64", index=a.index)
    if ok.any():
        x, y = np.stack(a[ok].to_numpy()).astype(float), np.stack(b[ok].to_numpy()).astype(float)
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        out[ok] = np.einsum("ij,ij->i", x, y) / np.where(n > 0, n, 1)
    return out
