"""Suffix-array dedup over bytes: column-wise construction of a collection's Burrows-Wheeler order.

Bytes covered by a 200-byte string that occurs anywhere else are removed. Each window's anchor is its smallest 64-byte
gram by hash, so equal windows lie alike around equal anchors. Spark counts anchors; passages around those that
repeat go, by anchor, into bounded collections. There one symbol of every passage is inserted each round, from the
right: a stable sort by the new symbol turns the order of the suffixes at one column into that at the next, with
their common prefixes. Columns come from an external file in the shared folder, written once and read in sequence, so
beside the passages themselves memory holds a few numbers for each. As passages are laid out around their anchors, suffixes that
can share 200 bytes always stand in the same column, and one column's order is all that is kept.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from storyloom.llm import repeats
from storyloom.llm.common import mix, scratch, scratch_path
from storyloom.llm.recompress import rolling

#: Bytes of a window and of an anchor's gram; bytes handled at once; bytes that a file's buffer holds.
WINDOW, GRAM, AT_ONCE, BUFFER = 200, 64, 2 << 20, 1 << 20
PASSAGES = "bucket int, id binary, th binary, pos binary, a binary, b binary, shown binary, content binary"
FOUND = "id long, th long, lo long, hi long"
_symbol = mix(np.arange(256, dtype=np.uint64), 9)


def raw_of(text) -> bytes:
    t = text.as_py() if hasattr(text, "as_py") else text
    return (t or "").encode("utf-8", "surrogatepass")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row: of a block's suffix and the next block's prefix."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces_of(ths: list[int], texts, window: int, at_once: int):
    """Groups of (th, offset, bytes): texts of at least a window, long ones cut so that each window is whole in one piece."""
    held, n = [], 0
    for th, t in zip(ths, texts, strict=True):
        raw = raw_of(t)
        for lo in range(0, max(0, len(raw) - window + 1), at_once):
            piece = raw[lo : lo + at_once + window - 1]
            held.append((th, lo, piece))
            n += len(piece)
            if n >= at_once:
                yield held
                held, n = [], 0
    if held:
        yield held


def anchors(ths: list[int], texts, window: int = WINDOW, gram: int = GRAM, at_once: int = AT_ONCE) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: its hash, text, place, and the distances from the first and last window's start."""
    out: dict[str, list] = {k: [] for k in ("h", "th", "pos", "a", "b")}
    for held in pieces_of(ths, texts, window, at_once):
        size = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(size) - size
        sym = _symbol[np.frombuffer(b"".join(p for _, _, p in held), np.uint8)]
        h = mix(rolling(sym, gram, 0x9E3779B97F4A7C15))
        # Ties go to the left; positions stay below 2^24, as a piece is at most twice AT_ONCE long.
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        best = (sliding_min(key, window - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        count = size - window + 1
        start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc, at = np.repeat(np.arange(len(size)), count), best[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        d = doc[first]
        out["h"].append(h[at[first]])
        out["th"].append(np.array([t for t, _, _ in held], np.int64)[d])
        out["pos"].append(at[first] - begin[d] + np.array([o for _, o, _ in held])[d])
        out["a"].append(at[first] - start[first])
        out["b"].append(at[first] - start[last])
    return {k: np.concatenate(v) if v else np.zeros(0, repeats.KINDS[k]) for k, v in out.items()}


def passages(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """The bytes around repeated anchors, in buckets by anchor. Equal ones of a batch are known to repeat: their windows go out at once (bucket -1) and one of them goes on, not to be shown."""

    def run(batches):
        for b in batches:
            ids, ths, places = b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("anchors")
            seen: dict[tuple, list] = {}
            for i, t in enumerate(b.column("text")):
                if not places[i].is_valid or not len(places[i]):
                    continue
                raw = raw_of(t)
                for pos, a, e, h in zip(*(c.to_pylist() for c in places[i].values.flatten()), strict=True):
                    seen.setdefault((h, a, e, raw[pos - a : pos - e + window]), []).append((ids[i], ths[i], pos))
            rows: dict[int, list] = {}
            known = []
            for (h, a, e, content), where in seen.items():
                distinct = dict.fromkeys(where)
                rows.setdefault((h & (1 << 64) - 1) % buckets, []).append((*where[0], a, e, len(distinct) == 1, content))
                if len(distinct) > 1:
                    known += [(i, t, p, a, e, True, b"") for i, t, p in distinct]
            if known:
                rows[-1] = known
            columns = [[], [], [], [], [], [], [], []]
            for k, r in rows.items():
                for c, v in zip(columns, [k, *(np.array(x, t).tobytes() for x, t in zip(zip(*[x[:6] for x in r], strict=True), (np.int64, np.int64, np.int64, np.int32, np.int32, np.uint8), strict=True)), b"".join(x[6] for x in r)], strict=True):
                    c.append(v)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "id", "th", "pos", "a", "b", "shown", "content"])

    return docs.mapInArrow(run, PASSAGES)


def reach(first: np.ndarray, end: np.ndarray, column: int) -> np.ndarray:
    """The passages that have a byte in a column."""
    return np.flatnonzero((first <= column) & (column < end))


def exactly(stream, n: int) -> bytes:
    """n bytes; a remote store may hand out fewer at once."""
    data = stream.read(n)
    while len(data) < n:
        more = stream.read(n - len(data))
        if not more:
            raise OSError("a file of columns is too short")
        data += more
    return data


@contextmanager
def columns_of(content: bytes, size: np.ndarray, first: np.ndarray, end: np.ndarray, width: int, folder: str | None):
    """A stream of the passages' bytes, column by column from the last to the first; its file goes when it has been read."""
    begin = np.cumsum(size) - size
    raw = np.frombuffer(content, np.uint8)

    def write(to) -> None:
        for column in range(width - 1, -1, -1):
            there = reach(first, end, column)
            to.write(raw[begin[there] + column - first[there]].tobytes())

    if folder is None:
        to = pa.BufferOutputStream()
        write(to)
        yield pa.BufferReader(to.getvalue())
        return
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}"
    with store.open_output_stream(path, buffer_size=BUFFER) as to:
        write(to)
    try:
        with store.open_input_stream(path, buffer_size=BUFFER) as columns:
            yield columns
    finally:
        store.delete_file(path)


def repeated_windows(content: bytes, a: np.ndarray, b: np.ndarray, window: int, folder: str | None = None) -> list[tuple[np.ndarray, int]]:
    """(passages, distance) of windows that start `distance` before their anchor and occur twice or more.

    order: the passages that reach the column, by the suffix that starts there. prefix[k]: bytes that suffixes k-1
    and k have in common, up to the shorter one's end. folder: where the file of columns lies; none for one in memory.
    """
    size, top = a - b + window, int(a.max())
    width = top + window - int(b.min())
    end = top - b + window  # first column after each passage
    by_end = np.argsort(-end, kind="stable")
    ends = -end[by_end]
    by_start = np.argsort(-(top - a), kind="stable")
    starts = -(top - a)[by_start]
    order, prefix, out = np.zeros(0, np.int64), np.zeros(0, np.int32), []
    symbols = np.zeros(len(a), np.uint8)
    with columns_of(content, size, top - a, end, width, folder) as columns:
        for column in range(width - 1, -1, -1):
            there = reach(top - a, end, column)
            symbols[there] = np.frombuffer(exactly(columns, len(there)), np.uint8)
            gone = by_start[slice(*np.searchsorted(starts, [-(column + 1), -column]))]
            if len(gone):  # these began in the column before: their neighbours share what all between had in common
                leaves = np.zeros(len(a), bool)
                leaves[gone] = True
                stay = np.flatnonzero(~leaves[order])
                prefix = np.minimum.reduceat(prefix[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else prefix[:0]
                order = order[stay]
            new = by_end[slice(*np.searchsorted(ends, [-(column + 1), -column]))]
            if len(new):
                order, prefix = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), prefix])
                prefix[0] = 0
            if not len(order):
                continue
            symbol = symbols[order]
            longer = np.zeros(len(order), np.int32)
            for s in np.flatnonzero(np.bincount(symbol, minlength=256)).tolist():
                at = np.flatnonzero(symbol == s)
                if len(at) > 1:
                    # Each slice ends with the next suffix that has this symbol.
                    longer[at[1:]] = 1 + np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1)
            turn = np.argsort(symbol, kind="stable")
            order, prefix = order[turn], longer[turn]
            far = prefix >= window
            if far.any():
                hit = far.copy()
                hit[:-1] |= far[1:]
                out.append((order[hit], top - column))
    return out


def solve(window: int, folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ths, pos, a, b, shown = (np.frombuffer(b"".join(pdf[k]), t) for k, t in (("id", np.int64), ("th", np.int64), ("pos", np.int64), ("a", np.int32), ("b", np.int32), ("shown", np.uint8)))
        found = repeated_windows(b"".join(pdf["content"]), a.astype(np.int64), b.astype(np.int64), window, folder)
        if not found:
            return pd.DataFrame({"id": ids[:0], "th": ths[:0], "lo": pos[:0], "hi": pos[:0]})
        who = np.concatenate([w for w, _ in found])
        start = pos[who] - np.concatenate([np.full(len(w), d) for w, d in found])
        keep = shown[who] > 0
        who, start = who[keep], start[keep]
        order = np.lexsort((start, who))
        who, start = who[order], start[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(who)) - 1 if len(who) else lo
        return pd.DataFrame({"id": ids[who[lo]], "th": ths[who[lo]], "lo": start[lo], "hi": start[hi] + 1})

    return run


def known_windows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, ths, pos, a, b = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in (("id", np.int64), ("th", np.int64), ("pos", np.int64), ("a", np.int32), ("b", np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.array(pos - a), pa.array(pos - b + 1)], ["id", "th", "lo", "hi"])


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with keep_bytes: kept) for each row of docs.

    Rows with equal texts repeat each other whole: all of a text of at least `window` bytes goes, and one of them
    stands for all in the search. Null and empty texts have no byte; repeated rows count as copies; null doc_ids are
    allowed. A very long text is searched in pieces, but is one row: memory grows with its bytes. Other columns are not
    read; an empty table gives no row.
    """
    base = repeats.base_of(docs)
    status = repeats.statuses(base)
    buckets = repeats.buckets_for(status)
    places = repeats.repeated_anchors(base, lambda ths, texts: anchors(ths, texts, window, gram), buckets)
    packed = scratch(passages(repeats.with_anchors(base, status, places), buckets, window), "passages")
    found = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(solve(window, scratch_path(docs.sparkSession, "columns")), FOUND)
    found = found.union(packed.where("bucket < 0").mapInArrow(known_windows, FOUND))
    told = repeats.with_spans(base, status, scratch(found, "found"))

    def run(batches):
        for batch in batches:
            rows = []
            spans, copies = batch.column("spans").to_pylist(), batch.column("copies").to_pylist()
            for i, t in enumerate(batch.column("text")):
                raw = raw_of(t)
                kept, runs = raw, 0
                if copies[i] > 1 and len(raw) >= window:
                    kept, runs = b"", 1
                elif spans[i]:
                    gone = repeats.covered(len(raw), spans[i], window)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            n, r, k, s, x = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            arrays = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, r, k)), pa.array(s, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.binary())] * keep_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    return told.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
