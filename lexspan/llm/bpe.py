"""Byte-level BPE over blocks of documents: splitting by numpy, each distinct piece tokenised once.

A text is first cut into pieces (an optional space and letters, digits or other signs;
white space; English contractions), as the vocabulary's own pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does,
and merges never cross a piece's ends. So what a piece yields doesn't depend on its
surroundings and is kept, with the piece's bytes, for as long as a worker lives
(at most ``STORE`` pieces; then the store starts anew, which costs time only).
Documents that hold a special token's string go to the library as they are.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexspan.llm.blocks import TextBlock, quick_hashes

STORE = 600_000
_OTHER, _LETTER, _DIGIT, _SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []
#: White space of the pattern: the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    if not _CLASSES:
        kinds = {"L": _LETTER, "N": _DIGIT}
        out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[_WHITE] = _SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def code_points(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Each character's code point and its first byte's place in ``block.data``."""
    data = block.data
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, lead


def pieces(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all pieces, in order, and each document's first piece (n + 1 of them)."""
    points, lead = code_points(block)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
    kind = _classes()[points]
    top = np.zeros(len(points) + 1, bool)  # a document starts here
    top[np.searchsorted(lead, block.starts)] = True
    top[-1] = True
    fresh = np.empty(len(points), bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= top[:-1]
    white = kind == _SPACE
    blank = points == 0x20
    start = fresh.copy()
    start[1:] &= white[1:] | ~blank[:-1] | top[1:-1]  # a run of signs starts at the one space before it
    start[:-1] |= white[:-1] & ~white[1:] & ~top[1:-1]  # the last white space before a sign starts a piece
    quote = np.flatnonzero((points == 0x27) & fresh & start)
    for p in quote[quote + 1 < len(points)]:
        if top[p + 1] or kind[p + 1] != _LETTER:
            continue
        pair = chr(points[p + 1]) + (chr(points[p + 2]) if p + 2 < len(points) and not top[p + 2] else "")
        size = 2 if pair in ("re", "ve", "ll") else 1 if pair[:1] in ("s", "t", "m", "d") else 0
        if size:
            start[p + 1] = False
            if p + 1 + size < len(points):
                start[p + 1 + size] |= kind[p + 1 + size] == _LETTER or top[p + 1 + size]
    at = lead[start]
    return at, np.searchsorted(at, block.starts, "left")


class Vocabulary:
    """A byte-level BPE file of the ``tokenizers`` library; its tables are read when the prefix counts first need them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["normalizer"] or told["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        self.special = [t["content"] for t in told["added_tokens"]]
        self.path = path
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        spelled = _byte_letters()
        return {i: bytes(spelled[c] for c in text) for text, i in self._model()["vocab"].items()}

    @cached_property
    def id_of(self) -> dict[bytes, int]:
        return {raw: i for i, raw in self.bytes_of.items()}

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        spelled, out = _byte_letters(), {}
        for rank, pair in enumerate(self._model()["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (self.id_of[bytes(spelled[c] for c in s)] for s in (a, b))
            out[x, y] = rank, self.id_of[self.bytes_of[x] + self.bytes_of[y]]
        return out

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id_of))

    def _model(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    def merge(self, raw: bytes) -> list[int]:
        """Byte-pair merging as defined: the lowest-ranked pair first, the leftmost among equals."""
        out = [self.id_of[raw[i : i + 1]] for i in range(len(raw))]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: merging their joined bytes gives just these two again."""
        key = left, right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def whole(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def prefix_counts(self, raw: bytes) -> list[int]:
        """Exact token counts of every prefix of one piece's bytes (index 0: the empty prefix).

        The encoding of a prefix is that of a shorter prefix and one more token; of
        all tokens that end here just one fits the last token of what stands before
        it. So one pass that keeps the last token and the count of every prefix
        gives all counts, without encoding any prefix by itself.
        """
        counts, last = [0], [-1]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.id_of.get(raw[start:end])
                if token is not None and (self.whole(token) if start == 0 else self.fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:  # cannot happen while every byte is a token
                raise ValueError("no token fits")
        return counts


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


class PieceStore:
    """What ``measure`` says of each distinct piece, in arrays that whole blocks look up at once.

    A piece of up to seven bytes is its own key. Longer ones are found by hash and then
    compared byte by byte; one that shares its hash with another is kept apart by its bytes.
    """

    def __init__(self, measure: Callable[[list[bytes]], list[np.ndarray]]):
        self.measure = measure
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.raw_first = np.zeros(1, np.int64)
        self.raw = np.zeros(0, np.uint8)
        self.others: dict[bytes, int] = {}

    def _add(self, found: list[bytes]) -> np.ndarray:
        """New slots for these pieces."""
        values = self.measure(found)
        base = len(self.first) - 1
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(v) for v in values], dtype=np.int64)))
        self.flat = np.concatenate((self.flat, *values))
        self.raw_first = np.concatenate((self.raw_first, self.raw_first[-1] + np.cumsum([len(p) for p in found], dtype=np.int64)))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(found), np.uint8)))
        return base + np.arange(len(found))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every piece ``data[starts[i]:ends[i]]``; ``flat[first[slot]:first[slot + 1]]`` is its value."""
        sizes = ends - starts
        long = np.flatnonzero(sizes > 7)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        hashes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[starts] & _FIRST_BYTES[np.minimum(sizes, 7)] | sizes.astype(np.uint64) << np.uint64(56)
        hashes[long] = quick_hashes(data, starts[long], ends[long]) | np.uint64(255 << 56)
        distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > STORE:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = sample[~known]
            slots = self._add([data[s:e].tobytes() for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.slots = np.insert(self.slots, at[~known], slots)
            at = np.searchsorted(self.keys, distinct)
        slots = self.slots[at][back]
        for i in long[~self._same(data, starts[long], ends[long], slots[long])].tolist():
            piece = data[starts[i] : ends[i]].tobytes()
            if piece not in self.others:
                self.others[piece] = int(self._add([piece])[0])
            slots[i] = self.others[piece]
        return slots

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each piece has its slot's bytes."""
        sizes = ends - starts
        same = self.raw_first[slots + 1] - self.raw_first[slots] == sizes
        which = np.flatnonzero(same & (sizes > 0))
        if len(which):
            size = sizes[which]
            stops = np.cumsum(size)
            moved = np.arange(stops[-1])
            differ = self.raw[moved + np.repeat(self.raw_first[slots[which]] - (stops - size), size)] != data[moved + np.repeat(starts[which] - (stops - size), size)]
            if differ.any():
                same[which[np.searchsorted(stops, np.flatnonzero(differ), "right")]] = False
        return same


_STORES: dict[tuple[str, str], PieceStore] = {}


def store_of(vocab: Vocabulary, what: str, measure: Callable[[list[bytes]], list[np.ndarray]]) -> PieceStore:
    """The worker's store of ``what`` is measured by this vocabulary; it outlives the task."""
    return _STORES.setdefault((vocab.path, what), PieceStore(measure))


def plain(block: TextBlock, special: list[str]) -> np.ndarray:
    """Documents without any special token's string."""
    out = np.ones(block.n, bool)
    for text in special:
        out &= ~pc.fill_null(pc.match_substring(block.texts, text), False).to_numpy(zero_copy_only=False)
    return out


def library_ids(vocab: Vocabulary, found: list[bytes]) -> list[np.ndarray]:
    """Ids by the library, of pieces that it can't split further."""
    texts = [p.decode("utf-8") for p in found]
    out: list[np.ndarray] = []
    for i in range(0, len(texts), 4096):
        out += [np.array(e.ids, np.uint32) for e in vocab.library.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
    return out


def encoded(block: TextBlock, vocab: Vocabulary, store: PieceStore) -> Iterator[np.ndarray]:
    """Each document's ids (unsigned 32-bit); ``store`` measures by ``library_ids``."""
    starts, firsts = pieces(block)
    ends = np.append(starts[1:], len(block.data))
    slots = store.find(block.data, starts, ends)
    sizes = store.first[slots + 1] - store.first[slots]
    stops = np.concatenate(([0], np.cumsum(sizes)))
    flat = store.flat[np.arange(stops[-1]) + np.repeat(store.first[slots] - stops[:-1], sizes)]
    easy = plain(block, vocab.special)
    for i in range(block.n):
        if easy[i]:
            yield flat[stops[firsts[i]] : stops[firsts[i + 1]]]
        else:
            yield np.array(vocab.library.encode(block.texts[i].as_py(), add_special_tokens=False).ids, np.uint32)


def text_type(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field("text").type
