"""Words, word hashes and word-window hashes of a whole Arrow batch at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, unchanged; words never span documents. All hashes are
64-bit polynomial hashes modulo 2**64 over table-mixed bytes, with a final avalanche step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
_Q_INVERSE = U64(pow(int(_Q), -1, 2**64))
_P_INVERSE = U64(pow(int(_P), -1, 2**64))
#: Bytes hashed at once, so that temporary arrays stay small whatever the length of a document.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _chunk_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_P, n), powers(_P_INVERSE, n)


@dataclass
class Words:
    """Words of a batch: byte ranges in buf, and where each document's words begin (n_docs + 1 entries)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, doc: int) -> list[bytes]:
        """The words of one document."""
        a, b = self.first[doc], self.first[doc + 1]
        raw = self.buf
        return [raw[i:j].tobytes() for i, j in zip(self.start[a:b], self.end[a:b])]


def split_words(texts: pa.Array) -> Words:
    """Words of every text of a string array; a null text has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(texts) + 1, np.int64))
    space = _SPACE[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before = np.concatenate(([True], space[:-1]))
    before[inner] = True
    after = np.concatenate((space[1:], [True]))
    after[inner - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(words.start)
    out = np.empty(n, dtype=np.uint64)
    up, down = _chunk_powers(CHUNK_BYTES)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(words.end, words.start[a] + CHUNK_BYTES)))
        at = words.start[a:b] - words.start[a]
        seg = words.buf[words.start[a] : words.end[b - 1]]
        if len(seg) > len(up):  # a single word above the chunk's size
            up, down = powers(_P, len(seg)), powers(_P_INVERSE, len(seg))
        out[a:b] = np.add.reduceat(_BYTE[seg] * up[: len(seg)], at) * down[at]
        a = b
    return mix(out ^ (words.end - words.start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; entry i is the run that starts at i.

    Runs are not cut at documents: mask them with :func:`window_starts`.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = mix(hashes, seed) if seed else hashes
    up = powers(_Q, len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mix((total[width:] - total[:-width]) * powers(_Q_INVERSE, n), seed + 1)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over word positions: True where a window of ``width`` words fits into its document."""
    n = int(first[-1])
    fits = np.zeros(n + 1, dtype=np.int64)
    a, b = first[:-1], np.maximum(first[1:] - width + 1, first[:-1])
    np.add.at(fits, a, 1)
    np.add.at(fits, b, -1)
    return np.cumsum(fits[:-1]) > 0


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch with about ``most_bytes`` of text each; a longer text has a slice of its own."""
    sizes = np.asarray(pa.compute.binary_length(batch[column]).fill_null(0), dtype=np.int64)
    part = np.concatenate(([0], np.cumsum(sizes)[:-1])) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
