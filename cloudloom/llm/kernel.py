"""Vectorised text kernel: words, word hashes and n-gram hashes of whole Arrow batches, without a Python object a word.

A word's hash has 64 bits: its length and its bytes, eight at a time, each followed by a mixing step, so that no two
words share one by their structure, as they do under a polynomial modulo 2^64. Where an operator takes equal hashes for
equal words, n different words make about n^2 / 2^65 mistakes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel call takes at once; a longer text is a call of its own.
CHUNK_BYTES = 2 << 20
#: Bytes up to which words are hashed together, eight at a time; a longer one is hashed by itself.
LONG_WORD = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def separators(pattern: str) -> np.ndarray:
    """256 flags: 'space' is 0x20 and 0x09-0x0D; 'word' is ASCII but for digits and letters."""
    flags = np.zeros(256, bool)
    if pattern == "space":
        flags[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "word":
        flags[:128] = True
        flags[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    else:
        raise ValueError(f"unknown separators {pattern!r}")
    return flags


def mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of some texts: byte starts and ends, and first[i]..first[i + 1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seps: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~seps[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
        opens[first] |= inside[first]
        closes[last] |= inside[last]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool) -> np.ndarray:
        """Of the words, with A-Z lower-cased if asked."""
        data, size = _LOWER[self.data] if lower else self.data, self.ends - self.starts
        eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # from each place on
        h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C13) + U64(0x632BE59BD9B4E019))
        done, at = 0, np.arange(len(size))
        while len(at) and done < LONG_WORD:
            part = eight[self.starts[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
            h[at] = mix(h[at] ^ part)
            done += 8
            at = at[size[at] > done]
        for i in at.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return h


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for each i with n words left; the caller keeps to one text's words."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        out += h[k : len(h) - n + 1 + k] * U64(factor)
    return mix(out + U64(n))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about size bytes of text, or of one longer text."""
    data, offsets = texts_of(batch.column(batch.schema.names.index(text)))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
