"""Words of whole texts as 64-bit hashes, with their places: what searching and phrase mining share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wavecohort.llm.common import mix64, text_buffers

#: Bytes that are handled at once, whatever the length of a text.
CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the seed's base, and of its inverse modulo 2 ** 64: a base for each seed, so that words that share a
    hash under one do not under another."""
    base = (0x9E3779B97F4A7C15 ^ (2 * seed)) % 2**64 | 1
    out = []
    for b in (base, pow(base, -1, 2**64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, out=x))
    return out[0], out[1]


def byte_set(*parts: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: single bytes and closed ranges of bytes."""
    out = np.zeros(256, bool)
    for p in parts:
        out[slice(p[0], p[1] + 1) if isinstance(p, tuple) else p] = True
    return out


@dataclass
class Words:
    """Words in the order of the texts: their hashes, the rows' n+1 offsets into them, their first and last+1 byte in
    ``data``, and how many break bytes come before each."""

    hashes: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    data: np.ndarray

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words of the numbers given, A-Z lower-cased."""
        size = (self.ends - self.begins)[which]
        at = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(self.begins[which], size)
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(at), pa.py_buffer(_FOLD[self.data[take]])])


def _cuts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that end where a row or a word does; a longer word is a range of its own."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + CHUNK, end)
        while stop < end and not separators[data[stop]]:
            ahead = np.flatnonzero(separators[data[stop : stop + 4096]])
            here = stop + (int(ahead[0]) if len(ahead) else min(4096, end - stop))
            row = int(offsets[np.searchsorted(offsets, stop)])
            stop = min(row, here)
            if row <= here:
                break
        yield at, stop
        at = stop


def words(col: pa.Array, separators: np.ndarray, breaks: np.ndarray | None = None, seed: int = 0) -> Words:
    """All words of a string column: runs of bytes that are no separators, A-Z lower-cased. A null text has none."""
    data, offsets = text_buffers(col)
    first, last, made, broken = [], [], [], []
    before = 0
    if len(offsets) > 1:
        for at, stop in _cuts(data, offsets, separators):
            part = data[at:stop]
            inside = ~separators[part]
            edge = np.zeros(len(part) + 1, bool)  # rows end words
            lo, hi = np.searchsorted(offsets, at), np.searchsorted(offsets, stop, side="right")
            edge[offsets[lo:hi] - at] = True
            edge[0] = edge[-1] = True
            s = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
            e = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
            up, down = _powers(seed, len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((_FOLD[part].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            h = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            made.append(np.maximum(h, np.uint64(1)))  # 0 stands for no word
            first.append(s + at)
            last.append(e + at)
            if breaks is not None:
                seen = np.zeros(len(part) + 1, np.int64)
                np.cumsum(breaks[part], out=seen[1:])
                broken.append(seen[s] + before)
                before += int(seen[-1])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    begins = cat(first, np.int64)
    rows = np.searchsorted(begins, offsets, side="left").astype(np.int64) if len(offsets) > 1 else np.zeros(len(offsets), np.int64)
    piece = cat(broken, np.int64) if breaks is not None else np.zeros(len(begins), np.int64)
    return Words(cat(made, np.uint64), rows, begins, cat(last, np.int64), piece, data)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have about ``most`` bytes together (a longer text is alone), to bound what a worker holds."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
