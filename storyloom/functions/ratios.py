"""Likeness of names, a whole batch of pairs at a time: weighted best of whole, token and window ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight of token ratios, of windows, of windows in names more than MUCH times as long; from FEW times on windows count.
TOKENS, WINDOWS, FAR_WINDOWS, FEW, MUCH = 0.95, 0.9, 0.6, 1.5, 8.0


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names as rows of a matrix, and their lengths."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    out = np.zeros((len(names), max(int(size.max(initial=0)), 1)), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def common(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs.

    A row of the usual table is one 64-bit number for each pair, a bit for each character of the shorter name; a step
    adds one character of every longer name. Where even the shorter has more than 64 characters, the pair is stepped alone.
    """
    out = np.zeros(len(x), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y, strict=True)]
    short = np.array([i for i, (a, _) in enumerate(pairs) if len(a) <= 64], dtype=np.int64)
    if len(short):
        a, na = _codes([pairs[i][0] for i in short])
        b, nb = _codes([pairs[i][1] for i in short])
        row = np.full(len(short), ~np.uint64(0))
        wide = np.zeros((len(short), 64), bool)
        with np.errstate(over="ignore"):
            for t in range(b.shape[1]):
                wide[:, : a.shape[1]] = (a == b[:, t : t + 1]) & (t < nb)[:, None]
                hit = row & np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()
                row = (row + hit) | (row - hit)
        mask = np.where(na == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(na, 63).astype(np.uint64)) - np.uint64(1))
        out[short] = np.bitwise_count(~row & mask)
    for i, (a, b) in enumerate(pairs):
        if len(a) > 64:
            at: dict[str, int] = {}
            for k, c in enumerate(a):
                at[c] = at.get(c, 0) | 1 << k
            full = row = (1 << len(a)) - 1
            for c in b:
                hit = row & at.get(c, 0)
                row = (row + hit | row - hit) & full
            out[i] = len(a) - row.bit_count()
    return out


def _share(same: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * same / np.maximum(total, 1), 1.0)


def _sizes(x: list[str]) -> np.ndarray:
    return np.fromiter(map(len, x), np.int64, len(x))


def ratio(x: list[str], y: list[str]) -> np.ndarray:
    """Twice the common subsequence as a share of both lengths."""
    return _share(common(x, y), _sizes(x) + _sizes(y))


def _windows(s: str, t: str) -> list[str]:
    """Parts of t to hold s against: as long as s, and shorter ones at both ends."""
    n = len(s)
    return [t[max(0, i) : i + n] for i in range(1 - n, len(t))] if n else [t]


def partial_ratio(x: list[str], y: list[str]) -> np.ndarray:
    """The best ratio of the shorter name and a window of the longer; of names of one length, either may be the shorter."""
    one, two, size = [], [], []
    for a, b in zip(x, y, strict=True):
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        w = [(s, v) for v in _windows(s, t)] + ([(t, v) for v in _windows(t, s)] if len(s) == len(t) else [])
        one.extend(p for p, _ in w)
        two.extend(q for _, q in w)
        size.append(len(w))
    if not size:
        return np.zeros(0)
    return np.maximum.reduceat(ratio(one, two), np.cumsum(size) - size)


def token_ratio(x: list[str], y: list[str]) -> np.ndarray:
    """The better of the ratio of sorted words and that of word sets: names whose words are all in the other's are equal."""
    words = [(sorted(a.split()), sorted(b.split())) for a, b in zip(x, y, strict=True)]
    whole = ratio([" ".join(a) for a, _ in words], [" ".join(b) for _, b in words])
    both = [" ".join(sorted(set(a) & set(b))) for a, b in words]
    one, two = [" ".join(sorted(set(a) - set(b))) for a, b in words], [" ".join(sorted(set(b) - set(a))) for a, b in words]
    n, a, b = _sizes(both), _sizes(one), _sizes(two)
    gap = (n > 0).astype(np.int64)
    # The shared words and a space are common to both; what is left is compared by itself.
    sets = _share(n + gap + common(one, two), 2 * (n + gap) + a + b)
    sets = np.where(n > 0, np.maximum(sets, np.maximum(_share(n, 2 * n + gap + a), _share(n, 2 * n + gap + b))), sets)
    sets = np.where((n > 0) & ((a == 0) | (b == 0)), 1.0, sets)
    return np.maximum(whole, np.where([bool(p and q) for p, q in words], sets, 0.0))


def partial_token_ratio(x: list[str], y: list[str]) -> np.ndarray:
    """1 where names share a word, else the best window ratio of their sorted words, with or without repetitions."""
    words = [(sorted(a.split()), sorted(b.split())) for a, b in zip(x, y, strict=True)]
    shared = np.array([bool(set(a) & set(b)) for a, b in words], dtype=bool)
    out = partial_ratio([" ".join(a) for a, _ in words], [" ".join(b) for _, b in words])
    again = partial_ratio([" ".join(sorted(set(a))) for a, _ in words], [" ".join(sorted(set(b))) for _, b in words])
    return np.where(shared, 1.0, np.maximum(out, again))


def likeness(x: list[str], y: list[str]) -> np.ndarray:
    """From 0 to 1; 0 where a name is empty."""
    n, m = _sizes(x), _sizes(y)
    out = np.zeros(len(x))
    full = (n > 0) & (m > 0)
    longer = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)

    def some(mask):
        i = np.flatnonzero(mask)
        return i, [x[k] for k in i], [y[k] for k in i]

    i, a, b = some(full & (longer < FEW))
    if len(i):
        out[i] = np.maximum(ratio(a, b), TOKENS * token_ratio(a, b))
    i, a, b = some(full & (longer >= FEW))
    if len(i):
        scale = np.where(longer[i] <= MUCH, WINDOWS, FAR_WINDOWS)
        out[i] = np.maximum(ratio(a, b), scale * np.maximum(partial_ratio(a, b), TOKENS * partial_token_ratio(a, b)))
    return out


def most_alike(x: list[str], y: list[str]) -> np.ndarray:
    """What likeness cannot exceed: for two different names of one word from how often each character stands in both, else 1.

    Of such names the token ratios are the ratio itself, and c common characters make at most 2 c / (n + m) of whole names, or
    2 c / (n + c) of the shorter name and a window. Characters are counted in 32 classes, which can only add to what is common.
    """
    place, names = pd.factorize(np.array([*x, *y], dtype=object))
    codes, size = _codes(names.tolist())
    row, column = np.nonzero(np.arange(codes.shape[1]) < size[:, None])
    counts = np.bincount(row * 32 + codes[row, column] % 32, minlength=len(names) * 32).reshape(-1, 32).astype(np.int32)
    one = np.fromiter((len(s.split()) == 1 and s == s.strip() for s in names), bool, len(names))
    i, j = place[: len(x)], place[len(x) :]
    c = np.minimum(counts[i], counts[j]).sum(axis=1)
    least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    whole, window = 2 * c / np.maximum(least + most, 1), WINDOWS * 2 * c / np.maximum(least + c, 1)
    bound = np.where(most < FEW * least, whole, np.maximum(whole, window))
    return np.where(one[i] & one[j] & (i != j), bound, 1.0)


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the likeness of names is at least so much; it is computed only where the characters that they share allow it."""
    x, y, out = a.tolist(), b.tolist(), np.zeros(len(a), bool)
    may = np.flatnonzero(most_alike(x, y) >= least.to_numpy() - 1e-9) if x else []
    if len(may):
        out[may] = likeness([x[k] for k in may], [y[k] for k in may]) >= least.to_numpy()[may]
    return pd.Series(out, index=a.index)


@F.pandas_udf(T.DoubleType())
def wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """likeness of two columns of names, an Arrow batch at a time; null where one is null."""
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[ok] = likeness(a[ok].tolist(), b[ok].tolist())
    return pd.Series(out, index=a.index).where(pd.Series(ok, index=a.index), None)
