"""Whole texts as flat byte arrays, so that numpy handles a block of documents at once.

A block holds whole documents only: at most ``limit`` bytes of UTF-8, or one longer
document. That bounds a worker's memory by the longest document, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1_000_000


def quoted(name: str) -> str:
    """A column's name as Spark must read it: dots and back-ticks in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def numbered(frame: DataFrame) -> DataFrame:
    """The frame with its columns named ``c0``, ``c1`` ...: ``mapInArrow`` takes no names with dots."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class TextBlock:
    """UTF-8 bytes of some documents: ``data[starts[i]:starts[i + 1]]`` is document i; nulls are empty."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.cast(pa.large_string())
        self.n = len(texts)
        offsets = np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset : self.texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = self.texts.buffers()[2] if self.n else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.starts = offsets - offsets[0]
        self.lengths = np.diff(self.starts)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (in ``data``) of the maximal runs of word bytes, and each document's first word's index (n + 1 of them)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        inside = is_word[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = self.starts[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begins[edges] = inside[edges]  # a word never runs over two documents
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edges - 1] = inside[edges - 1]
        first = np.flatnonzero(begins)
        return first, np.flatnonzero(ends) + 1, np.searchsorted(first, self.starts, "left")


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on after its task, often idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, TextBlock]]:
    """The batches, cut into blocks of whole documents."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        total = np.cumsum(sizes)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, TextBlock(column(part, text))
            at = to
    give_back()


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: Bytes of words that white space ends: all but U+0020 and U+0009 to U+000D.
SPACED = ~(byte_table((0x20, 0x20), (0x09, 0x0D)))
#: Bytes of words of digits, small letters and all beyond ASCII (after lower-casing A to Z).
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A to Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words are polynomials modulo these two primes; a modulus of a power of two would give words of a
#: regular build (Thue-Morse sequences) the same hash whatever the base.
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_RNG = np.random.default_rng(20240607)
_BASES = [int(_RNG.integers(1 << 20, p - 1)) for p in _PRIMES]
_BYTE_KEYS = [_RNG.integers(1, p, 256, dtype=np.uint64) for p in _PRIMES]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, prime: int, size: int) -> np.ndarray:
    """base**i modulo the prime for i below ``size``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    return out[:size]


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [(_power_table(b, p, size), _power_table(pow(b, -1, p), p, size)) for b, p in zip(_BASES, _PRIMES)]
    return _POWERS


def _polynomials(values: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``[starts[i]:ends[i]]`` of values (below the prime, an array for each prime), the same wherever the run stands."""
    lanes = []
    for own, (up, down), prime in zip(values, _powers(len(values[0]) + 1), _PRIMES):
        p = np.uint64(prime)
        sums = np.empty(len(own) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(own * up[: len(own)] % p, out=sums[1:])  # below 2**64 up to 2**33 values
        lanes.append((sums[ends] - sums[starts]) % p * down[starts] % p)
    return mix(mix(lanes[0] << np.uint64(32) | lanes[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (62 bits of two primes and the length) of each ``data[starts[i]:ends[i]]``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return _polynomials([keys[data] for keys in _BYTE_KEYS], starts, ends)


_QUICK = np.uint64(0x9E3779B97F4A7C15)
_QUICK_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_QUICK_POWERS: list[np.ndarray] = []


def quick_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Like ``word_hashes``, three times as fast, but words of a regular build may share one: for callers that compare the bytes too."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if not _QUICK_POWERS or len(_QUICK_POWERS[0]) <= len(data):
        size = max(len(data) + 1, 1 << 16)
        _QUICK_POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b)))) for b in (_QUICK, _QUICK_BACK)]
    up, down = _QUICK_POWERS
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_KEYS[0][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``words[starts[i]:ends[i]]`` of 64-bit values, in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return _polynomials([mix(words ^ np.uint64(0xA0761D6478BD642F * i)) % np.uint64(p) for i, p in enumerate(_PRIMES)], starts, ends)


_LANES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` successive word hashes (may run over documents; callers drop those)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total += words[j : j + count] * _LANES[j % 64]
        if j % 64 == 63:
            total = mix(total)
    return mix(total)
