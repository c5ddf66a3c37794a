"""Alignment of a byte-level tokenizer with a piece tokenizer over the same texts, and how sure each link of ids is."""

from __future__ import annotations

import gc
import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.bytepairs import CUT, SLICE
from storyloom.llm.common import scratch

SPACE = "▁"
#: Units of text that are aligned at once; links up to which the table of counts may be broadcast.
UNITS, BROADCAST_ROWS = 20_000, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """The bytes of each id: A a byte-level vocabulary (tokenizers), B a piece vocabulary with byte fallback (sentencepiece)."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters, n = byte_letters(), self.a.get_vocab_size()
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in map(self.a.id_to_token, range(n))]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, byte in pieces]
        self.b_is_byte = np.array([byte for _, byte in pieces])
        self.a_len, self.b_len = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))

    def links(self) -> int:
        """The most id pairs that can end together: one's bytes are then the end of the other's."""
        of = [dict.fromkeys(v, 0) for v in (self.a_bytes, self.b_bytes)]
        for seen, v in zip(of, (self.a_bytes, self.b_bytes), strict=True):
            for x in v:
                seen[x] += 1
        return sum(seen.get(x[i:], 0) for seen, v in ((of[1], self.a_bytes), (of[0], self.b_bytes)) for x in v for i in range(len(x)))


def token_ends(start: np.ndarray, end: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The byte at which each token ends. start, end: the bytes of its span, which covers whole characters; size: its decoded bytes; part: whether it is a byte of a run of bytes that goes on.

    Spans are coarse cuts: they place a token unless the next one begins in the same character or the token is one
    of several bytes. Those that they don't place end as many bytes after the last placed one as were decoded.
    """
    placed = np.append(start[1:] >= end[:-1], True) & ~part
    total = np.cumsum(size)
    anchor = np.maximum.accumulate(np.where(placed, np.arange(len(end)), -1))
    known = np.maximum(anchor, 0)
    return total + np.where(anchor >= 0, end[known] - total[known], 0)


class Aligner:
    """Alignments of units of text, kept by number: group texts, token counts and, one after the other, links."""

    def __init__(self, v: Vocabularies, cache: int = 900_000):
        self.v, self.limit = v, cache
        ends = lambda words, *marks: [[f"{w}{m}" for w in words] for m in marks]
        self.a_text = ends(range(len(v.a_bytes)), ",", "|")
        self.b_text = ends(range(len(v.b_bytes)), ",", ";")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a = self.n_b = np.zeros(0, np.int64)
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, units: set[str]) -> None:
        missing = [u for u in units if u not in self.number]
        if len(self.number) + len(missing) > self.limit and self.number:
            self.forget()
            missing = list(units)
        collects = gc.isenabled()
        gc.disable()  # spans are many tuples without cycles, which the collector would walk through again and again
        try:
            for lo in range(0, len(missing), UNITS):
                self.align(missing[lo : lo + UNITS])
        finally:
            if collects:
                gc.enable()

    def _encoded(self, units: list[str]) -> tuple[list[str], list, list]:
        """Units whose tokens' bytes are a space and the unit, with the tokens of both sides; the others get the number -1."""
        v = self.v
        a = v.a.encode_batch([" " + u for u in units], add_special_tokens=False)
        b = v.b.encode(units, return_type="offset_mapping", num_threads=1)
        ids = [x.ids for x in a], [x["ids"] for x in b]
        whole = "".join([" " + u for u in units]).encode()
        if all(b"".join([own[i] for x in side for i in x]) == whole for side, own in zip(ids, (v.a_bytes, v.b_bytes), strict=True)):
            good = range(len(units))
        else:
            right = lambda u, x, own: b"".join([own[i] for i in x]) == (" " + u).encode()
            good = [i for i, u in enumerate(units) if right(u, ids[0][i], v.a_bytes) and right(u, ids[1][i], v.b_bytes)]
            self.number.update((u, -1) for u in set(units) - {units[i] for i in good})
        return [units[i] for i in good], [(ids[0][i], a[i].offsets) for i in good], [(ids[1][i], b[i]["offsets"]) for i in good]

    def align(self, units: list[str]) -> None:
        """Gives each unit a number and keeps the alignment of a space and the unit under it."""
        v = self.v
        good, a_side, b_side = self._encoded(units)
        if not good:
            return
        chars = np.array([len(u) + 1 for u in good])
        first = np.cumsum(chars) - chars
        codes = np.frombuffer("".join([" " + u for u in good]).encode("utf-32-le"), "<u4")
        byte_of = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])

        def flat(x, depth=1):
            for _ in range(depth):
                x = chain.from_iterable(x)
            return np.fromiter(x, np.int64)

        def side(tokens, size, shift, is_byte):
            n = np.array([len(ids) for ids, _ in tokens])
            ids = flat(ids for ids, _ in tokens)
            # Spans are characters of a unit: of A with the space before it, of B without.
            span = byte_of[flat((s for _, s in tokens), 2).reshape(-1, 2) + (np.repeat(first, n) + shift)[:, None]]
            part = is_byte[ids] & np.append(is_byte[ids][1:], False)
            return n, ids, token_ends(span[:, 0], span[:, 1], size[ids], part)

        n_a, a, a_end = side(a_side, v.a_len, 0, np.zeros(len(v.a_len), bool))
        n_b, b, b_end = side(b_side, v.b_len, 1, v.b_is_byte)
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        i, j = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        # The tokens' texts in order: a group's A tokens, then its B tokens; the last of each side closes it.
        a_group, b_group = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        texts = np.empty(len(a) + len(b), object)
        for ids, own, text, place in ((a, i, self.a_text, np.arange(len(a)) + np.append(0, j + 1)[a_group]), (b, j, self.b_text, np.arange(len(b)) + (i + 1)[b_group])):
            last = np.zeros(len(ids), np.int64)
            last[own] = 1
            texts[place] = [text[k][t] for k, t in zip(last.tolist(), ids.tolist(), strict=True)]
        texts, ends, lo = texts.tolist(), (np.cumsum(n_a) + np.cumsum(n_b)).tolist(), 0
        at = len(self.groups)
        for k, (u, hi) in enumerate(zip(good, ends, strict=True)):
            self.number[u] = at + k
            self.groups.append("".join(texts[lo:hi]))
            lo = hi
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.first = np.concatenate([self.first, len(self.links) + np.searchsorted(both, byte_of[first + chars], "right")])
        self.links = np.concatenate([self.links, a[i] << 32 | b[j]])

    def texts(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, digest of the groups, links, how often each) of each text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < SLICE):
                size += len(texts[end] or "")
                end += 1
            cut = [CUT.split(t) if t else [] for t in texts[at:end]]
            self.learn({u for us in cut for u in us})
            for us in cut:
                known = [self.number[u] for u in us]
                if not known or min(known) < 0:
                    yield 0, 0, 0, "", (), ()
                    continue
                k = np.array(known)
                n = self.first[k + 1] - self.first[k]
                links = self.links[np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                pair, times = np.unique(links, return_counts=True)
                groups = hashlib.sha256("".join([self.groups[x] for x in known])[:-1].encode()).hexdigest()
                yield int(self.n_a[k].sum()), int(self.n_b[k].sum()), len(links), groups, pair, times
            at = end


_aligners: dict[int, Aligner] = {}


def aligner(a_json: str, b_model: bytes) -> Aligner:
    """One aligner for each worker process and pair of vocabularies."""
    key = hash((a_json, b_model))
    if key not in _aligners:
        _aligners[key] = Aligner(Vocabularies(a_json, b_model))
    return _aligners[key]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links): links holds (pair, n), the id pairs a << 32 | b that end together and how often, of each row of docs."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shipped = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        own = aligner(*shipped.value)
        for b in batches:
            got = list(own.texts(b.column("text").to_pylist()))
            a, c, n, g, p, k = zip(*got, strict=True) if got else ((),) * 6
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in p])]).astype(np.int32)
            flat = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (p, k)]
            links = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(flat, ["pair", "n"]))
            arrays = [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (a, c, n)], pa.array(g, pa.string()), links]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair:long,n:long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return scratch(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how often all rows link a pair of ids, and whether no other pair of its B id is linked more often."""
    counts = rows.select(F.explode("links").alias("l")).groupBy(F.col("l.pair").alias("pair")).agg(F.sum("l.n").alias("count"))
    counts = scratch(counts, "links")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    A (tokenizers, byte-level) encodes a space and the text, B (sentencepiece, with a dummy space) the text; their spans
    (of B its offset mapping, as the installed version has no immutable proto any more) are refined by decoded bytes; special
    tokens' strings are plain text. Both cut at single spaces inside a text, so equal units of text are aligned once a
    task. Null and empty texts, and those whose tokens' bytes are not the text's (U+2581 turns into a space), have zeros
    and the digest ''. Repeated rows get equal rows and count each time; a row without doc_id keeps null; an empty table
    gives none; other columns are not read. Very long texts are aligned in full. The counts have a row for each pair of
    ids that can end together, which the vocabularies bound: they are broadcast if that bound is small, else shuffled.
    """
    rows = aligned(docs, a_path, b_path)
    counts = link_counts(rows)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        bound = Vocabularies(f.read(), g.read()).links()
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    each = rows.select(*keys, F.explode_outer("links").alias("l")).select(*keys, F.col("l.pair").alias("pair"), F.col("l.n").alias("n"))
    each = each.join(F.broadcast(counts) if bound <= BROADCAST_ROWS else counts, "pair", "left")
    zero = F.lit(0).cast("long")
    out = each.groupBy(*keys).agg(F.coalesce(F.sum("n"), zero).alias("n_links"), F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), zero).alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("count")), zero).alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
