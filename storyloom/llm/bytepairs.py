"""Byte-level pair encoding and decoding by recursive DuckDB queries, one database for each worker process."""

from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space between two characters that are no white space: no match of the usual patterns reaches over the cut before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text that are cut at once; words and bytes of one recursive query; bytes from which a word counts as long; rounds of a query on long words.
SLICE, WORDS, BYTES, LONG, ROUNDS = 4_000_000, 16_000, 1_000_000, 64, 48

#: Rows (w, p, id, nid, q): word, position, token there, the next token and its position. A round finds each word's
#: pair of the least rank, the leftmost of equal ones, and puts the merged token in its place; a word without a pair is done.
CONTRACT = """WITH RECURSIVE t AS (
  SELECT w, p, id, nid, q, false AS done FROM start
  UNION ALL
  (WITH best AS (SELECT w, min(m.id << 32 | p) AS b, arg_min(q, m.id << 32 | p) AS q FROM t JOIN merges m ON m.pair = (t.id << 32 | t.nid) WHERE NOT done AND nid >= 0 GROUP BY w),
   pick AS (SELECT w, b >> 32 AS id, b & 4294967295 AS p, q FROM best),
   put AS (SELECT k.w, k.id, k.p, k.q, r.nid, r.q AS after FROM pick k JOIN t r ON r.w = k.w AND r.p = k.q)
   SELECT t.w, t.p, CASE WHEN t.p = put.p THEN put.id ELSE t.id END,
     CASE WHEN t.p = put.p THEN put.nid WHEN t.q = put.p THEN put.id ELSE t.nid END,
     CASE WHEN t.p = put.p THEN put.after ELSE t.q END, put.w IS NULL
   FROM t LEFT JOIN put ON put.w = t.w WHERE NOT t.done AND (put.w IS NULL OR t.p <> put.q)))
SELECT w, p, id, done FROM t WHERE done"""

#: The same for long words, with all places of the least rank in one round, from left to right; it stops after some rounds and goes on from there.
CONTRACT_LONG = f"""WITH RECURSIVE t AS (
  SELECT w, p, id, 0 AS i, false AS done FROM start
  UNION ALL
  (WITH pairs AS (SELECT w, p, id, i, lead(id) OVER o AS nid, row_number() OVER o AS n FROM t WHERE NOT done AND i < {ROUNDS} WINDOW o AS (PARTITION BY w ORDER BY p)),
   least AS (SELECT pairs.*, m.id AS m, min(m.id) OVER (PARTITION BY w) AS b FROM pairs LEFT JOIN merges m ON m.pair = (pairs.id << 32 | pairs.nid)),
   runs AS (SELECT *, coalesce(m = b, false) AS hit, n - sum(coalesce(m = b, false)::INT) OVER (PARTITION BY w ORDER BY n) AS run FROM least),
   put AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY n) % 2 = 1 AS here FROM runs)
   SELECT w, p, CASE WHEN here THEN m ELSE id END, i + 1, b IS NULL
   FROM (SELECT *, lag(here, 1, false) OVER (PARTITION BY w ORDER BY n) AS gone FROM put) WHERE NOT gone))
SELECT w, p, id, done FROM t WHERE done OR i = {ROUNDS}"""

#: The ids of each word in order, as 32-bit integers, and the bytes that they decode to.
DECODE = "SELECT w, unhex(string_agg(le, '' ORDER BY p)) AS ids, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def classes_apart() -> dict[int, str]:
    """Characters that the regex library and that of tiktoken put into different classes, as their Unicode versions differ, each with a character of the class that counts."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    out = {}
    for kind, same in ((r"\p{L}", "a"), (r"\p{N}", "0")):
        own = set(regex.findall(kind, every))
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        out |= {ord(c): "\ue000" for c in own - theirs if ord(c) not in out} | {ord(c): same for c in theirs - own}
    return out


class PairCodec:
    """Encoder and decoder for ranks that are ids.

    The merge table has a row for each way to put a token together from two. A word that is a token is that token;
    other words go through the recursive query. For words of up to LONG bytes a round contracts one pair. For longer
    ones it contracts all places of the least rank, which gives the same if the bytes of every token merge into that
    token, as then no round makes a pair of lower rank; the tests state this for the vocabulary in use.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 800_000):
        self.ranks, self.pattern, self.limit, self.cache, self.older = ranks, regex.compile(pattern), cache, {}, {}
        self.apart = classes_apart()
        self.plain = self.pattern.findall(" ab cd") == [" ab", " cd"]  # a word with its space is one match
        self.letters_apart = frozenset(map(chr, self.apart))
        merges = np.array([(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], dtype=np.int64).reshape(-1, 2)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        for name, table in (("merges", {"pair": merges[:, 0], "id": merges[:, 1]}), ("vocabulary", {"id": list(ranks.values()), "hex": [t.hex() for t in ranks], "le": [r.to_bytes(4, "little").hex() for r in ranks.values()]})):
            self.db.register("rows", pa.table(table))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")

    def _start(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(x) for x in words])
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        w, p = np.repeat(np.arange(len(words)), n), np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        last = p == np.repeat(n, n) - 1
        return pa.table({"w": w, "p": p, "id": ids, "nid": np.where(last, -1, np.append(ids[1:], -1)), "q": np.where(last, -1, p + 1)})

    def _rows(self, query: str, start: pa.Table) -> pa.Table:
        self.db.register("start", start)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister("start")

    def _contracted(self, words: list[bytes], long: bool) -> pa.Table:
        """(w, p, id): the tokens of each word."""
        rows = self._rows(CONTRACT_LONG if long else CONTRACT, self._start(words))
        parts = []
        while True:
            done = rows["done"].to_numpy(zero_copy_only=False)
            parts.append(rows.filter(pa.array(done)).select(["w", "p", "id"]))
            if done.all():
                return pa.concat_tables(parts)
            rows = self._rows(CONTRACT_LONG, rows.filter(pa.array(~done)).select(["w", "p", "id"]))

    def words(self, words: list[bytes]) -> list:
        """The ids of each word, as 32-bit integers; where these decode to other bytes, ids and bytes."""
        out: list = [self.ranks.get(x) for x in words]
        rest = [i for i, r in enumerate(out) if r is None]
        out = [None if r is None else r.to_bytes(4, "little") for r in out]
        short, long = [i for i in rest if len(words[i]) <= LONG], [i for i in rest if len(words[i]) > LONG]
        batches = [short[at : at + WORDS] for at in range(0, len(short), WORDS)]
        size = BYTES
        for i in long:
            if size + len(words[i]) > BYTES:
                batches.append([])
                size = 0
            batches[-1].append(i)
            size += len(words[i])
        for some in batches:
            self.db.register("tokens", self._contracted([words[i] for i in some], len(words[some[0]]) > LONG))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for w, ids, data in zip(got["w"].to_pylist(), got["ids"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                i = some[w]
                out[i] = ids if data == words[i] else (ids, data)
        return out

    def cut(self, unit: str) -> list[bytes]:
        """The matches of the pattern in a unit. Characters that the library knows otherwise are looked at as it does."""
        if unit.isascii():
            if self.plain and unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
                return [unit.encode()]
        elif not self.letters_apart.isdisjoint(unit):
            return [unit[m.start() : m.end()].encode() for m in self.pattern.finditer(unit.translate(self.apart))]
        return [w.encode() for w in self.pattern.findall(unit)]

    def learn(self, units: set[str]) -> None:
        """Puts the ids of each unit of text, as 32-bit integers, into the cache, and where they decode to other bytes these too; what was not met for long leaves it."""
        if len(self.cache) > self.limit:
            self.older, self.cache = self.cache, {}
        missing = []
        for u in units.difference(self.cache):
            known = self.older.get(u)
            if known is None:
                missing.append(u)
            else:
                self.cache[u] = known
        cut = [self.cut(u) for u in missing]
        distinct = list({w for ws in cut for w in ws})
        of = dict(zip(distinct, self.words(distinct), strict=True))
        for u, ws in zip(missing, cut, strict=True):
            self.cache[u] = of[ws[0]] if len(ws) == 1 else self._joined(ws, [of[w] for w in ws])

    def units(self, text: str) -> list[str]:
        """The text cut before single spaces inside it; every unit but the first begins with its space."""
        first, *rest = CUT.split(text)
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str | None) -> list[int]:
        units = self.units(text or "")
        self.learn(set(units))
        return np.frombuffer(self.joined(units)[0], "<u4").tolist()

    @staticmethod
    def _joined(texts: list[bytes], known: list):
        """One entry for several: the ids one after the other, and the bytes if any differ from the text's."""
        if tuple not in set(map(type, known)):
            return b"".join(known)
        return b"".join([k if type(k) is bytes else k[0] for k in known]), b"".join([t if type(k) is bytes else k[1] for t, k in zip(texts, known, strict=True)])

    def joined(self, units: list[str]) -> tuple[bytes, bytes]:
        """The ids of a text's units and the bytes that they decode to."""
        known = [self.cache[u] for u in units]
        if tuple not in set(map(type, known)):
            return b"".join(known), "".join(units).encode()
        return self._joined([u.encode() for u in units], known)

    def digests(self, texts: list[str | None]):
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes) of each text, in order."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < SLICE):
                size += len(texts[end] or "")
                end += 1
            cut = [self.units(t or "") for t in texts[at:end]]
            self.learn({u for us in cut for u in us})
            for us in cut:
                ids, data = self.joined(us)
                yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()
            at = end


_codecs: dict[int, PairCodec] = {}


def codec(ranks: dict[bytes, int], pattern: str) -> PairCodec:
    """One codec for each worker process and vocabulary."""
    key = hash((tuple(ranks.items()), pattern))
    if key not in _codecs:
        _codecs[key] = PairCodec(ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (with ids: the ids as well).

    Every match of the pattern is encoded by itself, and a text's distinct words go through DuckDB once. The pattern
    must end its matches before a single space inside the text, as the usual ones do. Null and empty texts have no
    token and the digests of no bytes. Repeated rows get equal rows, an empty table none; other columns are not read. Very
    long texts are cut in full; a very long word takes a round for each of its distinct pairs. The ranks, under 2 MB,
    travel with the task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        own = codec(shipped.value, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            n, i, d = zip(*own.digests(texts), strict=True) if texts else ((), (), ())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays.append(pa.array([own.encode(t) for t in texts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
