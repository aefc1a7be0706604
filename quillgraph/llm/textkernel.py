"""Vectorised text primitives that the operators of this subpackage share.

Everything works on Arrow string columns: one flat byte buffer and offsets, so
that splitting and hashing touch no Python object per word.  Words are always
``[^\\x20\\x09-\\x0D]+``: runs of bytes other than ASCII white space.
Null texts count as empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer document is handled alone.
SLICE_BYTES = 2 << 20
#: Ranges up to this many bytes are hashed by prefix sums, longer ones by blake2b: a polynomial modulo
#: 2^64 has known clashes from 1,024 bytes on, whatever its base (the Thue-Morse word and its complement).
SHORT = 64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

U64 = np.uint64
_WINDOW = 1 << 20  # bytes covered by one run of prefix sums
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_VALUE, _BYTE_VALUE_2 = (_rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1) for _ in range(2))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the murmur3 finaliser)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.full(_WINDOW + 1, _BASE, U64)
        down = np.full(_WINDOW + 1, inverse, U64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


class Texts:
    """A column of texts as flat bytes, and the words in it.

    data: all bytes; off: where each text starts, and the end;
    start, end: byte range of each word; first: index of each text's first word, and the end.
    """

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        _, offsets, data = column.buffers()
        n = len(column)
        off = np.frombuffer(offsets, np.int32, n + 1 + column.offset)[column.offset:] if n else np.zeros(1, np.int32)
        base, stop = int(off[0]), int(off[-1])
        self.n = n
        self.off = off.astype(np.int64) - base
        self.data = np.frombuffer(data, np.uint8, stop)[base:] if data is not None and stop > base else np.zeros(0, np.uint8)
        self._raw: bytes | None = None
        self.start = self.end = self.first = np.zeros(0, np.int64)

    @property
    def raw(self) -> bytes:
        if self._raw is None:
            self._raw = self.data.tobytes()
        return self._raw

    def split(self) -> Texts:
        ink = ~SPACE[self.data]
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        cut = self.off[1:-1]
        cut = cut[(cut > 0) & (cut < len(ink))]
        begins[cut] = ink[cut]
        ends[cut - 1] = ink[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        return self

    def word_hashes(self, lower: bool = False, second: bool = False) -> np.ndarray:
        """64-bit hashes of the words; lower: after A-Z became a-z; second: by another, independent function."""
        return self.hashes(self.start, self.end, lower, second)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges that follow one another; second: by another, independent function."""
        value = _BYTE_VALUE_2 if second else _BYTE_VALUE
        data = self.data
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * 32
        up, down = _tables()
        out = np.zeros(len(starts), U64)
        size = ends - starts
        long = np.flatnonzero(size > SHORT)
        k, n = 0, len(out)
        while k < n:
            a = int(starts[k])
            j = int(np.searchsorted(ends, a + _WINDOW, "right"))
            if j <= k:  # a word longer than the window: below
                k += 1
                continue
            part = np.empty(int(ends[j - 1]) - a + 1, U64)
            part[0] = 0
            np.cumsum(value[data[a:a + len(part) - 1]] * up[:len(part) - 1], out=part[1:])
            s, e = starts[k:j] - a, ends[k:j] - a
            out[k:j] = (part[e] - part[s]) * down[s]
            k = j
        out = mix(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))
        if len(long):
            raw = memoryview(data)
            key = b"2" if second else b"1"
            digests = [hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            out[long] = np.frombuffer(b"".join(digests), U64)
        return out

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `size` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(length)
        k = 0
        while k < batch.num_rows:
            j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
            yield batch.slice(k, j - k)
            k = j


def windows(h: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Hashes of all k consecutive values, by doubling; shorter by k - 1 than h."""
    if len(h) < k:
        return np.zeros(0, U64)
    have, width = h, 1
    out, done = None, 0
    need = k
    while need:
        if need & 1:
            if out is None:
                out, done = have, width
            else:  # what is done, then `width` more values
                m = len(h) - done - width + 1
                out = out[:m] * U64(pow(factor, width, 1 << 64)) + have[done:done + m]
                done += width
        need >>= 1
        if need:
            m = len(have) - width
            have = have[:m] * U64(pow(factor, width, 1 << 64)) + have[width:width + m] if m > 0 else np.zeros(0, U64)
            width *= 2
    return mix(out[:len(h) - k + 1])


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as the bigint that Spark knows."""
    return np.ascontiguousarray(h).view(np.int64)


def pick(df, *names: str):
    """Just these columns, whatever else the table has; a name that clashes only in case is no obstacle."""
    from pyspark.sql import functions as F

    fields = [f.name for f in df.schema.fields]
    if len({f.lower() for f in fields}) == len(fields):
        return df.select(*[F.col(f"`{n}`") for n in names])
    position = {f: i for i, f in reversed(list(enumerate(fields)))}
    return df.toDF(*[f"c{i}" for i in range(len(fields))]).select(*[F.col(f"c{position[n]}").alias(n) for n in names])


def numbered(df):
    """The same rows with columns named c0, c1 and so on, so that no names clash, and a function that gives the new name of a column."""
    fields = [f.name for f in df.schema.fields]
    place = {f: i for i, f in reversed(list(enumerate(fields)))}
    return df.toDF(*[f"c{i}" for i in range(len(fields))]), lambda name: f"c{place[name]}"
