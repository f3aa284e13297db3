"""What the corpus operators share: reading, small expressions, word hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inside(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it: for columns that a job adds for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def unit(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def crc_part(doc_id: Column, k: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


# --- words in numpy, over Arrow's own buffers -------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_CHUNK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _CHUNK + (1 << 16))
        for name, p in (("up", _P), ("down", _PINV)):
            base = np.full(size, p, np.uint64)
            base[0] = 1
            _powers[name] = np.cumprod(base, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if offs is not None else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def words_of(col: pa.Array, separators: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, A-Z lower-cased, and n+1 offsets of the rows' words. The bytes
    are handled in chunks of about 1 MB, cut at word ends, whatever the length of a text."""
    data, offsets = text_buffers(col)
    if len(offsets) < 2 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes, begins = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + _CHUNK, end)
        while stop < end:  # go on to the next separator or row
            ahead = separators[data[stop : min(stop + 4096, end)]]
            hit = np.flatnonzero(ahead)
            row = offsets[np.searchsorted(offsets, stop)]
            here = stop + (int(hit[0]) if len(hit) else len(ahead))
            if row <= here:
                stop = int(row)
                break
            stop = here
            if len(hit):
                break
        part = data[at:stop]
        inside = ~separators[part]
        first, last = np.searchsorted(offsets, at), np.searchsorted(offsets, stop)
        cuts = offsets[first:last] - at
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[cuts] = inside[cuts]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        finish[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(finish) + 1
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_FOLD[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        begins.append(s + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets, side="left").astype(np.int64)


def shingles_of(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; fewer words make one shingle, no word none."""
    n = len(words)
    if not n:
        return words
    mult = np.uint64(0xD6E8FEB86659FD93)
    m = min(n, k)
    h = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        h = h * mult + words[i : n - m + 1 + i]
    return np.unique(mix64(h))
