"""Words of many texts at once: positions and 64-bit hashes, by numpy over UTF-8 bytes.

All word classes here are sets of ASCII bytes plus every byte from 0x80 on, so they can be told
byte by byte. A-Z are lower-cased first. A word never runs over the end of its text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a block of texts; doc_ptr[i]:doc_ptr[i + 1] are those of text i."""

    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc_ptr: np.ndarray

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_ptr) - 1), np.diff(self.doc_ptr))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def scan(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    low = LOWER[data]
    is_word = word_bytes[low]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = is_word[heads]
    starts = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # by about a megabyte, so that 8-byte temporaries stay small
        origin = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, origin + _CHUNK, "right")))
        piece = low[origin : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        s, e = starts[done:upto] - origin, ends[done:upto] - origin
        total = np.zeros(len(piece) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(piece * _power(_P, len(piece))[: len(piece)], out=total[1:])
            hashes[done:upto] = mix((total[e] - total[s]) * _power(_P_INV, len(piece))[s] + (e - s).astype(np.uint64))
        done = upto
    return Words(low, starts, ends, hashes, np.searchsorted(starts, offsets))


def scan_column(column: pa.Array, word_bytes: np.ndarray) -> Words:
    return scan(*text_bytes(column), word_bytes)


def blocks(batch: pa.RecordBatch, text_at: int, most_bytes: int = 2 << 20):
    """Slices of whole rows with at most so many bytes of text each (more only for a single row)."""
    data_offsets = text_bytes(batch.column(text_at))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(data_offsets, data_offsets[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k - 1 starts have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_P) + hashes[i : i + n]
        return mix(out + np.uint64(k))
