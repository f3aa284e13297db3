"""Permutations of group labels by md5 and Poisson resamples by md5 or a stream of bits, for any number of subjects.

A permutation gives the first group's number of labels to the subjects of the smallest md5 of (seed, permutation,
subject). Its label is a comparison with the md5 of rank ``n1``, so that only cuts (16 bytes for each key and permutation)
are sent about, and subjects are labelled where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permutations that are hashed at once in a task: a matrix of these by a batch's subjects.
BLOCK = 50
#: Half the window about the expected cut, in standard deviations; a cut that lies outside is looked for in a wider one.
WIDTH = 5.0


def digests(seed: int, numbers: range, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the md5 of ``seed|number|id``: two matrices of numbers by ids."""
    md5 = hashlib.md5
    raw = b"".join([md5(head + i).digest() for head in (f"{seed}|{p}|".encode() for p in numbers) for i in ids])
    d = np.frombuffer(raw, ">u8").reshape(len(numbers), len(ids), 2).astype(np.uint64)
    return d[:, :, 0], d[:, :, 1]


def blocks(n: int) -> Iterator[range]:
    return (range(i, min(n, i + BLOCK)) for i in range(0, n, BLOCK))


#: The chances of 0, 1, ... in a Poisson variable with mean 1, and how many of 2^16 numbers stand for 0 to 5: their wholes.
#: The few numbers from ``_REST`` on stand for what the wholes leave, which 53 further bits tell apart.
_CHANCES = np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)])
_WHOLES = np.floor(_CHANCES[:6] * 2**16).astype(int)
_STEPS, _REST = [np.uint16(x) for x in np.cumsum(_WHOLES)[:-1]], np.uint16(_WHOLES.sum())
_LEFT = np.cumsum(_CHANCES - np.append(_WHOLES, np.zeros(14)) / 2**16)
_LEFT /= _LEFT[-1]
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place."""
    t = z >> np.uint64(30)
    for by, shift in ((_M1, np.uint64(27)), (_M2, np.uint64(31))):
        z ^= t
        z *= by
        np.right_shift(z, shift, out=t)
    z ^= t
    return z


def poisson_draws(seeds: np.ndarray, words: range) -> np.ndarray:
    """Poisson numbers with mean 1: a row for each of ``seeds`` (64 bits), four columns for each of ``words``. A seed's
    stream is that of SplitMix64, and a number takes 16 bits of it, or further bits where these do not decide."""
    z = _mixed(seeds[:, None] + np.arange(words.start + 1, words.stop + 1, dtype=np.uint64) * _GOLDEN)
    u = z.view("<u2")
    w = (u >= _STEPS[0]).view(np.uint8)
    for step in _STEPS[1:]:
        w += (u >= step).view(np.uint8)
    at = np.flatnonzero(u >= _REST)
    more = _mixed(z.reshape(-1)[at // 4] + (at % 4 + 1).astype(np.uint64) * _M2)
    w.reshape(-1)[at] = np.searchsorted(_LEFT, (more >> np.uint64(11)).astype(float) / 2.0**53, side="right")
    return w


def add_resampled(total: np.ndarray, seeds: np.ndarray, values: np.ndarray, rows: int = 256, words: int = 128) -> None:
    """Adds to ``total`` (resamples by sums) the rows of ``values`` (sums by rows), each times its number of draws; a block
    of rows by resamples that a processor's cache holds at a time."""
    for i in range(0, len(seeds), rows):
        for j in range(0, -(-len(total) // 4), words):
            out = total[4 * j : 4 * (j + words)]
            w = poisson_draws(seeds[i : i + rows], range(j, j + -(-len(out) // 4)))
            out += (values[:, i : i + rows] @ w.astype(float)).T[: len(out)]


def parts(f: pd.DataFrame, by: list[str]) -> list[tuple[tuple, np.ndarray]]:
    """Keys and row numbers of a batch."""
    if not by:
        return [((), np.arange(len(f)))]
    return [(k if isinstance(k, tuple) else (k,), np.asarray(i)) for k, i in f.groupby(by, sort=False, dropna=False).indices.items()]


def add_up(parts_of: DataFrame, keys: list[str], columns: list[str], fan_in: int = 64) -> DataFrame:
    """Sums of columns of 64-bit floats held as binary, elementwise, a row for each key: first over some of the tasks'
    rows, then over these sums, so that a group holds about ``fan_in`` rows of one key."""
    types = dict(parts_of.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{c}` binary" for c in columns)])

    def total(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = {k: [v] for k, v in zip(keys, key, strict=False)}
        for c in columns:
            sums = np.frombuffer(f[c].iloc[0], float).copy()
            for x in f[c].iloc[1:]:
                sums += np.frombuffer(x, float)
            out[c] = [sums.tobytes()]
        return pd.DataFrame(out)

    some = parts_of.withColumn("__some", F.expr(f"spark_partition_id() div {fan_in}"))
    return some.groupBy(*keys, "__some").applyInPandas(total, schema).groupBy(*keys).applyInPandas(total, schema)


def _window(n: int, n1: int, width: float) -> tuple[np.uint64, np.uint64]:
    q = n1 / n
    s = width * (q * (1 - q) / n) ** 0.5 + width / n
    low, high = max(0.0, q - s), q + s
    return np.uint64(int(low * 2**64)), np.uint64(2**64 - 1 if high >= 1 else int(high * 2**64))


def label_cuts(rows: DataFrame, by: list[str], subject: str, sizes: dict[tuple, tuple[int, int]], n_perms: int, seed: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """High and low halves of the md5 of rank n1 of every permutation, for each key of ``sizes`` (n, n1). ``rows``: one
    for each key and subject; subjects of a key differ.

    Tasks count the subjects under a window about the expected cut and send those within it alone; the exact cut is the
    one of the rank that is left. Cuts outside the window are looked for again in one twice as wide, up to all."""
    types = dict(rows.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in by)
    found: dict[tuple, list] = {k: [None] * n_perms for k in sizes}
    width = WIDTH
    while any(None in v for v in found.values()):
        windows = {k: _window(n, n1, width) for k, (n, n1) in sizes.items()}

        def near(frames: Iterator[pd.DataFrame], windows=windows) -> Iterator[pd.DataFrame]:
            for f in frames:
                at, names = pd.factorize(f["__id"])
                ids, split = [str(x).encode() for x in names], [x for x in parts(f, by) if x[0] in windows]
                for perms in blocks(n_perms):
                    hi, lo = digests(seed, perms, ids)
                    out = []
                    for key, i in split:
                        low, high = windows[key]
                        for p, h, x in zip(perms, hi[:, at[i]], lo[:, at[i]], strict=True):
                            hit = (h >= low) & (h <= high)
                            out.append([*key, p, int((h < low).sum()), np.c_[h[hit], x[hit]].astype(">u8").tobytes()])
                    yield pd.DataFrame(out, columns=[*by, "perm", "below", "near"])

        def cut(key, f: pd.DataFrame) -> pd.DataFrame:
            out = []
            for p, g in f.groupby("perm"):
                d = np.frombuffer(b"".join(g["near"]), ">u8").reshape(-1, 2)
                k = sizes[tuple(key[:-1])][1] - 1 - int(g["below"].sum())
                best = d[np.lexsort((d[:, 1], d[:, 0]))[k]].tobytes() if 0 <= k < len(d) else None
                out.append([*key[:-1], p, best])
            return pd.DataFrame(out, columns=[*by, "perm", "cut"])

        got = rows.select(*by, F.col(subject).cast("string").alias("__id")).mapInPandas(near, f"{head}perm int, below long, near binary")
        got = got.withColumn("block", F.expr(f"perm div {BLOCK}")).groupBy(*by, "block").applyInPandas(cut, f"{head}perm int, cut binary")
        for r in got.collect():  # 16 bytes for each key and permutation
            found[tuple(r[k] for k in by)][r["perm"]] = None if r["cut"] is None else bytes(r["cut"])
        width *= 2
    out = {}
    for k, v in found.items():
        d = np.frombuffer(b"".join(v), ">u8").reshape(-1, 2).astype(np.uint64)
        out[k] = (d[:, 0], d[:, 1])
    return out


def labels(hi: np.ndarray, lo: np.ndarray, cut: tuple[np.ndarray, np.ndarray], perms: range) -> np.ndarray:
    """1.0 for the subjects (columns) that a permutation (row) puts in the first group."""
    a, b = cut[0][perms.start : perms.stop, None], cut[1][perms.start : perms.stop, None]
    return ((hi < a) | ((hi == a) & (lo <= b))).astype(float)
