"""Vectorised tokens for one Arrow batch of texts.

The texts of a batch are joined into one byte buffer, words are found by a byte
class table and every word gets a 64-bit hash, all by numpy over the whole
buffer. Window hashes come from prefix sums, so a window of any length costs one
subtraction. Hashes depend on nothing but the bytes, so all tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes 9-13 and 32 separate words.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Lower-cases A-Z and turns every byte that is no ASCII digit or letter and below 0x80 to a space.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Lower-cases A-Z alone.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: each input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    if n:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class _Table:
    """Powers of the base and of its inverse, kept and grown as batches need them."""

    def __init__(self) -> None:
        self.up = self.down = _powers(0, _BASE)

    def need(self, n: int) -> None:
        if len(self.up) < n + 1:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(size, _BASE), _powers(size, _INV)


_table = _Table()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, that is the same wherever the span lies."""
    n = len(values)
    _table.need(n)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values.astype(np.uint64, copy=False) * _table.up[:n], out=prefix[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _table.down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a batch. Word i is data[starts[i]:ends[i]], in text doc[i]; text d has words first[d]:first[d+1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def positions(self) -> np.ndarray:
        """Each word's place in its text, from 0."""
        return np.arange(len(self.doc), dtype=np.int64) - self.first[self.doc]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that start k words of one text, and the hashes of these windows."""
        n = len(self.hashes)
        at = np.arange(max(0, n - k + 1), dtype=np.int64)
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, span_hashes(self.hashes, at, at + k)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def as_bytes(texts, table: bytes | None = None) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty; table maps single bytes (see WORD_TABLE)."""
    out = [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]
    return [b.translate(table) for b in out] if table else out


def words(raw: list[bytes]) -> Words:
    """The words of texts given as bytes: runs without white space (bytes 9-13 and 32)."""
    data = b"\n".join(raw) + b"\n"
    buffer = np.frombuffer(data, np.uint8)
    inside = np.empty(len(buffer) + 1, np.int8)
    inside[0] = 0
    inside[1:] = ~SPACES[buffer]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    first = np.searchsorted(starts, begins)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), np.diff(first))
    return Words(data, starts, ends, doc, first, span_hashes(buffer, starts, ends))


def batches(texts, size: int = 1_000_000):
    """Slices of a list of texts of about `size` characters each, so that buffers stay small; one long text is one slice."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and total + n > size:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))
