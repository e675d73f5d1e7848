"""Benchmark decontamination by a distributed positional inverted index.

The index is stored in the shared folder, split by document: each row holds a block of
documents with its sorted terms, the sorted positions where each term stands, and where the
documents begin. No row grows with the corpus, so a word or passage that a third of all
documents hold makes no task larger than another, and nothing is shuffled.

A window of a test item is looked up from its rarest term in the whole corpus: that term's
positions, moved by its place in the window, are intersected with the positions of the next
rarer term, and so on, until the whole window has matched or no position is left. Proximity
search intersects the same lists within a distance, in any order.

The test items go to every task. Their size is checked: beyond ``ITEM_BYTES`` they are
taken in several passes over the index, each with its own part of the items, which hand on
the words that are hit so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import ALNUM, LOWER, TextBlock, give_back, text_blocks, window_hashes, word_hashes
from lexspan.session import forget, settled, ship, spill, table

WINDOW = 10
#: UTF-8 bytes of test items that one pass sends to the executors.
ITEM_BYTES = 16_000_000
#: Keys of documents to leave out are broadcast up to this many rows; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The block's term hashes in order, and each document's first one (n + 1 of them)."""
    data = LOWER[block.data]
    lowered = TextBlock.__new__(TextBlock)
    lowered.data, lowered.starts, lowered.n = data, block.starts, block.n
    starts, ends, firsts = lowered.words(ALNUM)
    return word_hashes(data, starts, ends), firsts


class TestWindows:
    """The distinct windows of test items, by length, with the items that hold each."""

    def __init__(self, texts: list[str | None], size: int = WINDOW):
        block = TextBlock(pa.array(texts, pa.string()))
        hashes, firsts = terms(block)
        self.size = size
        kept: dict[int, dict[int, tuple[np.ndarray, list[int]]]] = {}
        for item in range(block.n):
            own = hashes[firsts[item] : firsts[item + 1]]
            length = min(size, len(own))
            if not length:
                continue
            group = kept.setdefault(length, {})
            for at, key in enumerate(window_hashes(own, length).tolist()):
                entry = group.setdefault(key, (own[at : at + length], []))
                if not entry[1] or entry[1][-1] != item:
                    entry[1].append(item)
        #: length -> (terms of each window, items of all windows in a row, where each window's items start)
        self.groups = {n: (np.stack([w for w, _ in g.values()]), np.concatenate([np.array(i) for _, i in g.values()]), np.concatenate(([0], np.cumsum([len(i) for _, i in g.values()])))) for n, g in kept.items()}
        #: All terms of the windows, sorted.
        self.vocabulary = np.unique(np.concatenate([w.ravel() for w, _, _ in self.groups.values()])) if self.groups else np.zeros(0, np.uint64)


class PositionalIndex:
    """Postings of one block: a term's positions are ``positions[first[t]:first[t + 1]]``, in rising order."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, positions: np.ndarray, size: int):
        """``terms``: sorted hashes; ``size``: words in the block."""
        self.terms, self.first, self.positions, self.size = terms, first, positions, size

    @classmethod
    def of(cls, hashes: np.ndarray) -> PositionalIndex:
        order = np.argsort(hashes, kind="stable")
        told = hashes[order]
        begins = np.flatnonzero(np.concatenate(([True], told[1:] != told[:-1]))) if len(told) else np.zeros(0, np.int64)
        return cls(told[begins], np.append(begins, len(told)), order, len(hashes))

    def within(self, vocabulary: np.ndarray) -> PositionalIndex:
        """The postings of the terms of ``vocabulary`` (sorted) only; terms that the block lacks have none."""
        at = np.searchsorted(self.terms, vocabulary)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == vocabulary[there]
        begin = np.where(there, self.first[np.minimum(at, len(self.first) - 1)], 0)
        n = np.where(there, self.first[np.minimum(at + 1, len(self.first) - 1)] - begin, 0)
        ends = np.cumsum(n)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)
        return PositionalIndex(vocabulary, np.concatenate(([0], ends)), self.positions[flat], self.size)

    def phrases(self, windows: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and start position of all places where the terms of a window (places in ``terms``) stand in a row.

        ``rarity``: how often each term stands in the whole corpus.
        """
        counts = np.diff(self.first)
        keys = (np.repeat(np.arange(len(self.terms)), counts) << 40) + self.positions  # all postings as one sorted list
        order = np.argsort(rarity[windows], axis=1, kind="stable")  # rarest first
        rows = np.flatnonzero((counts[windows] > 0).all(axis=1))
        out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = windows.shape[1]
        rarest = order[:, 0]
        lists = counts[windows[rows, rarest[rows]]]
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(lists) // 2_000_000)) + 1) if len(rows) else []:  # bounds the lists held at once
            anchor = windows[part, rarest[part]]
            n = counts[anchor]
            which = np.repeat(part, n)
            ends = np.cumsum(n)
            places = self.positions[np.arange(ends[-1]) + np.repeat(self.first[anchor] - (ends - n), n)] - rarest[which]
            good = (places >= 0) & (places + size <= self.size)
            which, places = which[good], places[good]
            for k in range(1, size):  # the list of the next rarer term, moved by its place in the window
                if not len(which):
                    break
                offset = order[which, k]
                want = (windows[which, offset] << 40) + places + offset
                good = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                which, places = which[good], places[good]
            out_w.append(which)
            out_p.append(places)
        return np.concatenate(out_w), np.concatenate(out_p)

    def near(self, codes: np.ndarray, slop: int, rarity: np.ndarray) -> np.ndarray:
        """Positions of the rarest of ``codes`` within ``slop`` of which all the others stand, in any order."""
        codes = codes[np.argsort(rarity[codes], kind="stable")]
        found = self.positions[self.first[codes[0]] : self.first[codes[0] + 1]]
        for c in codes[1:]:
            own = self.positions[self.first[c] : self.first[c + 1]]
            at = np.searchsorted(own, found - slop)
            found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= found + slop)] if len(own) else found[:0]
        return found


def search(index: PositionalIndex, firsts: np.ndarray, tests: TestWindows, rarity: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
    """Of a block's terms: whether each is inside an occurrence of a window; of its documents: the items that occur.

    ``index`` holds the terms of ``tests.vocabulary``; ``firsts``: each document's first word.
    """
    edges = np.zeros(index.size + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(firsts) - 1)]
    for size, (windows, held, held_at) in tests.groups.items():
        which, places = index.phrases(np.searchsorted(tests.vocabulary, windows), rarity)
        doc = np.searchsorted(firsts, places, "right") - 1
        inside = places + size <= firsts[doc + 1]  # not over a document's end
        which, places, doc = which[inside], places[inside], doc[inside]
        edges += np.bincount(places, minlength=len(edges)) - np.bincount(places + size, minlength=len(edges))
        pairs = np.unique(doc * len(windows) + which)
        for d, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist()):
            items[d].update(held[held_at[w] : held_at[w + 1]].tolist())
    return np.cumsum(edges[:-1]) > 0, items


def item_passes(benchmark: DataFrame, text: str, key: str) -> Iterator[Callable[[], tuple[list[str], list[str | None]]]]:
    """Readers of the test items (names and texts) in parts of about ``ITEM_BYTES`` at most; each part is read by itself."""
    read = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text).alias("t"))
    total = read.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-2 * total // ITEM_BYTES) if total > ITEM_BYTES else 1

    def part(p: int) -> tuple[list[str], list[str | None]]:
        rows = read.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == p).collect()
        return [r["k"] for r in rows], [r["t"] for r in rows]

    for p in range(parts):
        yield partial(part, p)


_INDEX = "terms array<long>, first array<int>, positions array<int>, firsts array<int>"


def _lists(*arrays: np.ndarray) -> list[pa.Array]:
    """Each array as a column of one row."""
    return [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays]


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of ``docs``, a row per block: ``keys`` and ``hashes`` (xxhash64 of the texts) of its documents, and the postings.

    Null and empty texts have no terms; repeated rows are documents like any other.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[_quoted(key)].alias("key"), docs[_quoted(text)].alias("text")).withColumn("th", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            hashes, firsts = terms(block)
            index = PositionalIndex.of(hashes)
            whole = pa.array([0, block.n], pa.int32())
            columns = [pa.ListArray.from_arrays(whole, _compact(batch.column(c))) for c in ("key", "th")]
            columns += _lists(index.terms.view(np.int64), index.first.astype(np.int32), index.positions.astype(np.int32), firsts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(columns, ["keys", "hashes", "terms", "first", "positions", "firsts"])

    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(run, f"keys array<{kind}>, hashes array<long>, {_INDEX}")


def _compact(column: pa.Array) -> pa.Array:
    """The values of a slice in an array of their own."""
    return pa.concat_arrays([column])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _index_of(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[PositionalIndex, np.ndarray]:
    """The postings of a stored row that ``vocabulary`` needs, and each document's first word."""
    own = lambda name: batch.column(name)[row].values.to_numpy()
    firsts = own("firsts").astype(np.int64)
    index = PositionalIndex(own("terms").view(np.uint64), own("first").astype(np.int64), own("positions").astype(np.int64), int(firsts[-1]))
    return index.within(vocabulary), firsts


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of ``vocabulary`` (sorted) stands in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("terms")[row].values.to_numpy().view(np.uint64)
                counts = np.diff(batch.column("first")[row].values.to_numpy())
                at = np.searchsorted(vocabulary, own)
                there = at < len(vocabulary)
                there[there] = vocabulary[at[there]] == own[there]
                sums[at[there]] += counts[there]
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["t", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    told = index.select("terms", "first").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the test items at most
    out[told.column("t").to_numpy()] = told.column("n").to_numpy()
    return out


def contaminated_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> tuple[DataFrame, list[str]]:
    """Per document of the index: ``key``, ``th``, ``n_words``, ``n_hit`` and ``items`` (sorted keys of items with occurring windows).

    And the tables that hold what earlier passes found, to forget after use.
    """
    spark = index.sparkSession
    found, paths = index.withColumn("hit", F.lit(None).cast("binary")).withColumn("items", F.lit(None).cast("array<array<string>>")), []
    kind = index.schema["keys"].dataType.elementType.simpleString()
    parts = list(item_passes(benchmark, text, item))
    for number, read in enumerate(parts):
        names, texts = read()
        tests = TestWindows(texts, window)
        rarity = term_counts(index, tests.vocabulary)
        last = number == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], names=names, tests=tests, rarity=rarity, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks, lists = [], []
                for row in range(batch.num_rows):
                    own, firsts = _index_of(batch, row, tests.vocabulary)
                    mark, occurring = search(own, firsts, tests, rarity)
                    held = [{names[i] for i in f} for f in occurring]
                    had = batch.column("hit")[row].as_py()
                    if had is not None:
                        mark = mark | np.unpackbits(np.frombuffer(had, np.uint8), count=len(mark)).astype(bool)
                        held = [a | set(b) for a, b in zip(held, batch.column("items")[row].as_py())]
                    if last:
                        sums = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
                        columns = [_compact(batch.column(c)[row].values) for c in ("keys", "hashes")] + [pa.array(np.diff(firsts)), pa.array(sums[firsts[1:]] - sums[firsts[:-1]]), pa.array([sorted(f) for f in held], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "th", "n_words", "n_hit", "items"])
                    marks.append(np.packbits(mark).tobytes())
                    lists.append([sorted(f) for f in held])
                if not last:
                    columns = {name: batch.column(name) for name in batch.schema.names} | {"hit": pa.array(marks, pa.binary()), "items": pa.array(lists, pa.list_(pa.list_(pa.string())))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            give_back()

        if last:
            found = found.mapInArrow(run, f"key {kind}, th long, n_words long, n_hit long, items array<string>")
        else:
            found, path = spill(spark, found.mapInArrow(run, found.schema))
            paths.append(path)
    return found, paths


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key, ``n_words``, ``n_hit`` and ``items`` (sorted keys, as strings, of items with occurring windows).

    Null and empty texts have no words; items without words have no windows. Repeated
    documents and items are rows like any other; a null item key is the text ``null``.
    An empty table of documents gives no rows, one of items no hits. Other columns are
    not read, whatever their names. The index is stored while it is searched.
    """
    spark = docs.sparkSession
    index, path = spill(spark, build_index(docs, text, key))
    found, paths = contaminated_index(index, benchmark, window, item_text, item)
    out = settled(spark, found.select(F.col("key").alias(key), "n_words", "n_hit", "items"))
    forget(spark, path, *paths)
    return out


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which no word is inside an occurrence of a window.

    Rows go by key and text, so equal rows go or stay together; null keys are equal here.
    Null and empty texts stay, and an empty table stays empty.
    """
    spark = docs.sparkSession
    index, path = spill(spark, build_index(docs, text, key))
    found, paths = contaminated_index(index, benchmark, window, item_text, item)
    gone = settled(spark, found.where("n_hit > 0").select(F.col("key").alias("its_key"), F.col("th").alias("its_th")).distinct())
    forget(spark, path, *paths)
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    whole = docs.select(F.struct("*").alias("whole"), docs[_quoted(key)].alias("key"), F.xxhash64(docs[_quoted(text)]).alias("th"))
    kept = whole.join(F.broadcast(gone) if small else gone, (F.col("th") == F.col("its_th")) & F.col("key").eqNullSafe(F.col("its_key")), "left_anti")
    return kept.select("whole.*")


def near_matches(docs: DataFrame, phrases: list[str], slop: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Proximity search: per row and phrase whose terms all stand within ``slop`` words of its rarest one, in any order.

    Columns: the key, ``phrase`` (its place in the list) and ``n_places``. Phrases
    without words match nothing. The list of phrases goes to every task and must be
    small (``ITEM_BYTES``).
    """
    if sum(len(p.encode()) for p in phrases) > ITEM_BYTES:
        raise ValueError(f"phrases of over {ITEM_BYTES} bytes")
    spark = docs.sparkSession
    index, path = spill(spark, build_index(docs, text, key))
    out = settled(spark, near_in_index(index, phrases, slop).withColumnRenamed("key", key))
    forget(spark, path)
    return out


def near_in_index(index: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """``key``, ``phrase``, ``n_places`` of ``near_matches`` from a stored index."""
    hashes, at = terms(TextBlock(pa.array(phrases, pa.string())))
    vocabulary = np.unique(hashes)
    rarity = term_counts(index, vocabulary)
    wanted = [np.unique(np.searchsorted(vocabulary, hashes[a:b])) for a, b in zip(at[:-1], at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, firsts = _index_of(batch, row, vocabulary)
                spaced = np.arange(own.size) + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)) * (2 * slop)  # documents lie apart
                own.positions = spaced[own.positions]
                rows, which, n = [], [], []
                for p, codes in enumerate(wanted):
                    if not len(codes) or not own.size:
                        continue
                    doc = np.searchsorted(firsts, np.searchsorted(spaced, own.near(codes, slop, rarity)), "right") - 1
                    docs_hit, counts = np.unique(doc, return_counts=True)
                    rows += docs_hit.tolist()
                    which += [p] * len(docs_hit)
                    n += counts.tolist()
                yield pa.RecordBatch.from_arrays([batch.column("keys")[row].values.take(pa.array(rows, pa.int64())), pa.array(which, pa.int32()), pa.array(n, pa.int64())], ["key", "phrase", "n_places"])

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return index.select("keys", "terms", "first", "positions", "firsts").mapInArrow(run, f"key {kind}, phrase int, n_places long")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    """What the query's ``items_sha256`` must be, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
