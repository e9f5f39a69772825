"""Vectorised helpers over the UTF-8 bytes of Arrow text columns, used inside tasks.

Texts are taken in chunks of about half a megabyte, so the arrays that grow with a chunk stay small; a longer
text forms a chunk alone. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random word per byte value.
BYTE_WORDS = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
#: The same with A-Z equal to a-z.
LOWER_BYTE_WORDS = BYTE_WORDS.copy()
LOWER_BYTE_WORDS[65:91] = BYTE_WORDS[97:123]
#: Bytes that end a word of the contract [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _MULT, np.uint64)
    down = np.full(size, _MULT_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse."""
    up, down = _powers(1 << max(20, int(n).bit_length()))
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, words: np.ndarray = BYTE_WORDS) -> np.ndarray:
    """Sums c with c[j] - c[i] a hash of data[i:j] up to the factor removed in `span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix64(raw + (end - start).astype(np.uint64) * BYTE_WORDS[7])


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) for runs of rows; offsets[i]:offsets[i+1] is the text of row first+i."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, offsets[first : last + 1] - offsets[first], whole[offsets[first] : offsets[last]]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each row's words begin among them (one entry more than rows).

    A word never crosses the end of a row.
    """
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] |= inside[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive word hashes; fewer words, but not none, form one shingle."""
    if len(words) == 0:
        return words
    width = min(size, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ words[i : i + len(out)]) * _MULT
        out ^= out >> np.uint64(29)
    return mix64(out + np.uint64(width))
