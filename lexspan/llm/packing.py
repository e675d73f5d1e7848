"""Best-fit packing of documents into fixed-length sequences, by bin completion.

The search runs on the counts of piece lengths alone: at most ``capacity`` numbers,
whatever the corpus. Its plan says which lengths share a sequence and how many such
sequences there are; every piece then finds its place from its rank among the pieces
of its length. Nothing is grouped by sequence, and no task ever holds more than one
slice of the pieces of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm import bpe
from lexspan.llm.blocks import numbered, quoted, text_blocks
from lexspan.session import forget, settled, ship, spill, table

#: Rows of one length that are ranked together, and into how many such slices a length is dealt at most.
SLICE, MAX_SLICES = 500, 4096
#: Choices of the search whose further branches are held ready; those of earlier choices are made again when needed.
LIVE_BRANCHES = 32
#: Fillings that a new one is compared with; also, after so many dominated ones a node is counted.
COMPARED = 64


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, after a first piece that may be shorter."""
    head = n % capacity
    return [head] * (head > 0) + [capacity] * (n // capacity)


# The search -----------------------------------------------------------------


def fillings(counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated ways to fill ``room`` from the lengths in ``counts``, least waste first; all of them, as far as asked for.

    Every filling is maximal: no length left would still fit. A filling is dominated if
    another one's items can each hold some of its items. Which sums the lengths from each
    place on can reach is known as bits, so no branch is entered that ends elsewhere.
    """
    sizes = sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True)
    kept: list[tuple[int, ...]] = []
    tried = 0
    for waste in range(min(most_waste, room) + 1):
        large = [s for s in sizes if s > waste]
        rest = tuple(s for s in sizes if s <= waste for _ in range(counts[s]))  # else the filling is not maximal
        total = room - waste - sum(rest)
        if total < 0:
            break
        reach = [1] * (len(large) + 1)
        mask = (1 << (total + 1)) - 1
        for k in range(len(large) - 1, -1, -1):
            sums, left, step = reach[k + 1], min(counts[large[k]], total // large[k]), 1
            while left:
                step = min(step, left)
                sums |= sums << (step * large[k]) & mask
                left -= step
                step *= 2
            reach[k] = sums
        work = [(0, total, ())]
        while work:
            k, missing, taken = work.pop()
            if not reach[k] >> missing & 1:
                continue
            if missing:
                size = large[k]
                for n in range(min(counts[size], missing // size) + 1):  # the last put is looked at first: larger items first
                    work.append((k + 1, missing - n * size, taken + (size,) * n))
                continue
            filling = taken + rest
            tried += 1
            if not any(holds(other, filling) for other in kept[:COMPARED]):
                kept.append(filling)
                yield filling
            elif tried % COMPARED == 0:
                yield None  # so that the caller's count of nodes ends a long search


def holds(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be put, several together, into items of ``big``."""
    if sum(small) > sum(big) or len(small) < len(big) and small != big:
        return small == big
    room = sorted(big)
    for s in sorted(small, reverse=True):  # best fit; a miss only keeps a filling that might go
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                room.sort()
                break
        else:
            return False
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counted lengths: patterns and how often each is used."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> patterns
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                per = min(capacity // size, left)
                times = left // per
                open_bins.setdefault(capacity - per * size, {})
                group = open_bins[capacity - per * size]
                group[(size,) * per] = group.get((size,) * per, 0) + times
                left -= times * per
                continue
            pattern, times = next(iter(open_bins[room].items()))
            now = min(times, left)
            if now == times:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
            else:
                open_bins[room][pattern] = times - now
            group = open_bins.setdefault(room - size, {})
            group[(*pattern, size)] = group.get((*pattern, size), 0) + now
            left -= now
    return [(p, n) for group in open_bins.values() for p, n in group.items()]


def plan(lengths: dict[int, int], capacity: int, nodes: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences each fills, in as few sequences as the search finds.

    Bin completion: the largest length left opens a sequence, the undominated fillings
    around it are the branches, best fit first. A filling is used as often as its
    counts allow, and less often only when all else has been tried. A branch goes when the
    waste so far leaves no way to beat the incumbent; the first incumbent is best-fit
    decreasing, and each completed descent that is better replaces it. The search ends
    when an incumbent meets the bound (total length over capacity, rounded up), when no
    branch is left, or after ``nodes`` nodes (4 for each distinct length, 4000 at least).
    """
    lengths = {int(s): int(n) for s, n in lengths.items() if n > 0}
    if any(s < 1 or s > capacity for s in lengths):
        raise ValueError("lengths must lie in 1 to the capacity")
    nodes = max(4000, 4 * len(lengths)) if nodes is None else nodes
    total = sum(s * n for s, n in lengths.items())
    least = -(-total // capacity)
    best = best_fit(lengths, capacity)
    best_bins = sum(n for _, n in best)
    visited, used, left = 0, 0, total
    counts = dict(lengths)
    # each entry: the choice that led here (pattern, times), its branches, and how many of these have been taken
    stack: list[list] = [[(), 0, None, 0]]
    while stack and best_bins > least and visited < nodes:
        entry = stack[-1]
        spare = (best_bins - 1 - used) * capacity - left  # waste that may still come
        choice = None
        if not counts:
            if used < best_bins:
                best_bins, best = used, [(p, n) for p, n, _, _ in stack[1:]]
        elif spare >= 0 and used + -(-left // capacity) < best_bins:
            if entry[2] is None:  # not begun, or put aside
                entry[2] = islice(_branches(counts, capacity, spare), entry[3], None)
            choice = next(entry[2], None)
        if choice is None:
            pattern, times, _, _ = stack.pop()
            for s in pattern:
                counts[s] = counts.get(s, 0) + times
            used, left = used - times, left + times * sum(pattern)
            continue
        pattern, times = choice
        visited += 1
        entry[3] += 1
        if pattern is None:
            continue
        waste = capacity - sum(pattern)
        if waste:
            times = max(1, min(times, spare // waste))
        for s in pattern:
            counts[s] -= times
            if not counts[s]:
                del counts[s]
        used, left = used + times, left - times * sum(pattern)
        stack.append([pattern, times, None, 0])
        if len(stack) > LIVE_BRANCHES:
            stack[-LIVE_BRANCHES][2] = None  # made again if the search comes back
    return best


def _branches(counts: dict[int, int], capacity: int, spare: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """A pattern around the largest length and how often to use it: each as often as it can, then each less often."""
    top = max(counts)
    rest = counts | {top: counts[top] - 1}
    told = []
    for filling in fillings(rest, capacity - top, spare):
        if filling is None:
            yield None, 0
            continue
        pattern = (top, *filling)
        times = min(counts[s] // pattern.count(s) for s in set(pattern))
        told.append((pattern, times))
        yield pattern, times
    for pattern, most in told:
        for times in range(most - 1, 0, -1):
            yield pattern, times


class Places:
    """The plan, turned round: for each length, which ranks stand in which sequences and where."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        filled = np.zeros(capacity + 1, np.int64)
        first = 0
        for pattern, times in patterns:
            offset = 0
            for s in pattern:
                runs.setdefault(s, []).append((int(filled[s]), first, offset))
                filled[s] += times
                offset += s
            first += times
        self.runs = {s: np.array(r, np.int64) for s, r in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            run = self.runs[int(lengths[group[0]])]
            at = np.searchsorted(run[:, 0], ranks[group], "right") - 1
            sequence[group] = run[at, 1] + ranks[group] - run[at, 0]
            offset[group] = run[at, 2]
        return sequence, offset


# On Spark -------------------------------------------------------------------


def ids_of_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, digest: Callable[[np.ndarray], int] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece of each row: the key, piece, start, length, and ``ids`` (binary, unsigned 32-bit little endian).

    A row's ids end with ``end_id``; a null or empty text has that id alone. With
    ``digest`` the column ``digest`` (long) replaces the ids.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    last = "digest long" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocabulary)
        store = bpe.store_of(vocab, "ids", lambda found: bpe.library_ids(vocab, found))
        for batch, block in text_blocks(batches):
            rows, numbers, starts, lengths, values = [], [], [], [], []
            for row, ids in enumerate(bpe.encoded(block, vocab, store)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for number, size in enumerate(cut_lengths(len(ids), capacity)):
                    part = ids[at : at + size]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at)
                    lengths.append(size)
                    values.append(digest(part) if digest else part.tobytes())
                    at += size
            columns = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, pa.int64() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", last.split(" ")[0]])

    return named.mapInArrow(run, f"key {kind}, piece int, start long, length long, {last}").withColumnRenamed("key", key)


def place(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), nodes: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice and should be a stored table. Equal rows in ``order`` are
    told apart by their other columns, as far as these differ. An empty table gives an
    empty result.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row for each length up to the capacity
    places = Places(plan(counts, capacity, nodes), capacity)
    slices = min(MAX_SLICES, max(1, -(-max(counts.values(), default=1) // SLICE)))
    dealt = pieces.withColumn("_slice", F.pmod(F.xxhash64(*(F.col(quoted(c)) for c in order)), F.lit(slices)))
    if slices == 1:
        ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length").orderBy(*(F.col(quoted(c)) for c in pieces.columns))).cast("long") - 1)
    else:
        before = dealt.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
        before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).drop("_n")
        within = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*(F.col(quoted(c)) for c in pieces.columns))).cast("long") - 1
        ranked = dealt.withColumn("_rank", within).join(before, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    ranked = numbered(ranked.select(*(F.col(quoted(c)) for c in pieces.columns), "_rank"))
    *kept, rank = ranked.columns
    length = kept[pieces.columns.index("length")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:-1]) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(length).to_numpy(), batch.column(rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema).toDF(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, digest: Callable[[np.ndarray], int] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack ``docs``: ``ids_of_pieces`` with ``sequence_id`` and ``offset``.

    Null and empty texts are one id long. Rows with null or equal keys are separate
    documents. Other columns are not read. The pieces are stored once in the shared
    folder while places are found.
    """
    spark = docs.sparkSession
    stored, path = spill(spark, ids_of_pieces(docs, vocabulary, capacity, end_id, digest, text, key))
    if digest is None:
        return place(stored, capacity, (key, "piece"))  # the ids stay in that table; it is the caller's to forget
    packed = settled(spark, place(stored, capacity, (key, "piece")))
    forget(spark, path)
    return packed


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=crc32_of).withColumnRenamed("digest", "ids_crc32")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, table(spark, sf_dir, "documents"))
