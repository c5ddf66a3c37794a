"""Piece encoding and decoding by the prefix table of merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, BYTE = 1, 6


def wire(data: bytes):
    """(field, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback, identity normalization and a dummy prefix.

    The last piece of every prefix's encoding is unique. For each prefix the automaton lists the pieces that end there;
    the one that starts at the text's beginning, or is compatible with the last piece of the prefix before it, is
    stored. The ids follow backwards from the end of the table.
    """

    def __init__(self, model: bytes, cache: int = 400_000):
        pieces = [(d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)) for d in (dict(wire(v)) for f, v in wire(model) if f == 1)]
        self.pieces = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == 3}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        runs = {p for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        self.longest_run = max(map(len, runs), default=1)
        # Ranks: single characters first, then pieces as they merge (a higher score merges earlier).
        order = sorted((p for p in self.ids if p not in runs), key=lambda p: (len(p) > 1, -pieces[self.ids[p]][1], self.ids[p]))
        self.text, self.rank = order, {p: r for r, p in enumerate(order)}
        self.id_of = [self.ids[p] for p in order]
        self.valid: dict[int, bool] = {}
        self.split: list[tuple[int, int]] = []
        self.automaton = ahocorasick.Automaton()
        for r, p in enumerate(order):
            self.automaton.add_word(p, r)
        self.automaton.make_automaton()
        for r, p in enumerate(order):
            self.split.append((r, r) if len(p) == 1 else self._last_merge(p))
        self.pair = {ab: r for r, ab in enumerate(self.split) if len(order[r]) > 1}
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.segments = re.compile(f"[{breaks}]|{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" if breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(len(p) > 1 + len(p.lstrip(SPACE)) for p in order):
            raise ValueError("a piece crosses words or starts with several spaces: segments can't be told apart")
        self.limit = cache
        self.forget()

    def forget(self) -> None:
        """Empties what is kept between texts. cache: the ids of segments, joined by commas; unlike: what those decode to whose text that is not."""
        self.cache: dict[str, str] = {}
        self.unlike: dict[str, str] = {}
        self.valid.clear()

    def _last_merge(self, piece: str) -> tuple[int, int]:
        """The two pieces that merge last into this one: the compatible ones that both merge earlier."""
        own = self.rank[piece]
        self.pair = {}
        for k in range(1, len(piece)):
            a, b = self.rank.get(piece[:k]), self.rank.get(piece[k:])
            if a is not None and b is not None and a < own and b < own and self._compatible(a, b, own):
                return a, b
        return own, own

    def _compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether a text that ends in a and goes on with b is never merged across the cut before either is whole."""
        text, split = self.text, self.split
        most = len(text) if limit is None else limit
        while True:
            joined = self.rank.get(text[a] + text[b])
            if joined is not None and joined < most:
                return False
            if a > b:  # a merged later: take it apart
                most, a_next = a, split[a][1]
                if a_next == a:
                    most, b_next = b + 1, split[b][0]
                    if b_next == b:
                        return True
                    b = b_next
                else:
                    a = a_next
            else:
                most, b_next = b + 1, split[b][0]
                if b_next == b:
                    most, a_next = a, split[a][1]
                    if a_next == a:
                        return True
                    a = a_next
                else:
                    b = b_next

    def table(self, word: str) -> list[int]:
        """Ids of a string without runs of spaces; what no piece covers becomes bytes."""
        last, start = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        valid, text = self.valid, self.text
        for end, r in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            at = end - len(text[r])
            before = last[at]
            if at and before >= 0:
                key = before << 32 | r
                ok = valid.get(key)
                if ok is None:
                    ok = valid[key] = self._compatible(before, r)
                if not ok:
                    continue
            elif at and word[at - 1] in self.ids:
                continue
            last[end], start[end] = r, at
        out, end = [], len(word)
        while end:
            if last[end] >= 0:
                out.append(self.id_of[last[end]])
                end = start[end]
            else:
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(word[end - 1].encode("utf-8", "replace")))
                end -= 1
        return out[::-1]

    def spaces(self, n: int) -> list[int]:
        """A run of spaces: all its merges rank alike, so it grows from the left."""
        one = self.ids[SPACE]
        if self.longest_run == 1:
            return [one] * n
        whole, rest = divmod(n, self.longest_run)
        return [self.ids[SPACE * self.longest_run]] * whole + ([self.ids[SPACE * rest]] if rest else [])

    def segment(self, s: str) -> list[int]:
        body = s.lstrip(SPACE)
        n = len(s) - len(body)
        if n > 1 or n and not body:
            if not body:
                return self.spaces(n)
            first = self.table(SPACE + body)
            if first[0] == self.ids[SPACE]:  # the last space merges with none of the letters
                return self.spaces(n) + first[1:]
            return self.spaces(n - 1) + first
        return self.table(s)

    def encode(self, text: str) -> list[int]:
        return [int(i) for known in self._known(self._segments(text)) for i in known.split(",")]

    def _segments(self, text: str) -> list[str]:
        return self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _known(self, parts: list[str]) -> list[str]:
        """The ids of each segment, joined by commas. `unlike` holds for these segments until the next call."""
        if len(self.cache) + len(parts) > self.limit or len(self.unlike) > self.limit:
            self.forget()
        known = self.cache.get
        return [known(s) or self._learn(s) for s in parts]

    def _learn(self, s: str) -> str:
        ids = self.segment(s)
        joined, back = ",".join(map(str, ids)), self.join(ids)
        if back != s.replace(SPACE, " "):
            self.unlike[s] = back
        if len(s) < 64:
            self.cache[s] = joined
        return joined

    def join(self, ids: list[int]) -> str:
        """The pieces' text; bytes that are not UTF-8 turn into U+FFFD one by one."""
        out, held = [], bytearray()

        def flush():
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                flush()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        flush()
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.join(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        parts = self._segments(text or "")
        for lo in range(0, len(parts), 1 << 16):
            some = parts[lo : lo + (1 << 16)]
            known = ",".join(self._known(some))
            n += known.count(",") + 1
            ids.update(("," * bool(lo) + known).encode())
            plain = "".join([self.unlike.get(s, s) for s in some] if self.unlike else some).replace(SPACE, " ")
            back.update((plain[1:] if not lo else plain).encode())
        return n, ids.hexdigest(), back.hexdigest()


_codecs: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each worker process and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (with ids: the ids as well).

    Null and empty texts have no token and the digests of the empty string. Repeated rows get equal rows, an empty
    table none; other columns are not read. The model, under 1 MB, travels with the task.
    """
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = codec(shipped.value)
        try:
            for b in batches:
                texts = b.column("text")
                rows = [own.digest(t.as_py()) for t in texts]
                n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
                arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays.append(pa.array([own.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            own.forget()  # Spark keeps the worker for other stages

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
