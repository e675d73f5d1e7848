"""Hard negatives for contrastive training, by bit-sliced integer products.

Components are integers in two's complement. A candidate's product with an anchor is summed
plane by plane, the sign plane first: after each plane the planes still to come can add no
more than their weight times the anchor's positive components and take no more than that
times its negative ones. So every pair has an interval that narrows with each plane, and a
pair is dropped once its interval lies outside what can still qualify: below the scores that
already fill the list, or outside the window of scores that is asked for. While most pairs
live a plane is a matrix product of bits; later the pairs left are counted one by one, as
bits that two words have in common.

The anchors are a stated set of queries. They go to the tasks in blocks of ``ANCHORS``, each
block in its own scan of all rows; a task keeps the best few of each list and only these are
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.vectors import kept_vectors, scaled
from lexspan.session import forget, settled, ship, spill, table

#: Anchors of one scan; with their lists some 10 MB in each task.
ANCHORS = 8192
#: Rows and anchors of which a task holds all pairs at once.
ROWS, COLUMNS = 512, 512
#: Under this share of live pairs these are followed one by one.
SPARSE = 0.05
#: Parts in which the lists of the tasks are merged first.
PARTS = 64
_LEAST = -(1 << 62)


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Planes of ``bits`` bits and a sign, the sign first: a row of 64-bit words for each row of ``x``."""
    padded = np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))
    shifts = np.arange(bits, -1, -1)[:, None, None]
    return np.packbits((padded[None] >> shifts) & 1, axis=2).view(np.uint64)


def plane_weights(bits: int) -> list[int]:
    return [-(1 << bits), *(1 << j for j in range(bits - 1, -1, -1))]


@dataclass
class Anchors:
    """Some anchors of one length of vectors."""

    x: np.ndarray
    bits: int

    def __post_init__(self):
        self.planes = bit_planes(self.x, self.bits)
        self.above = np.maximum(self.x, 0).sum(axis=1)
        self.below = np.minimum(self.x, 0).sum(axis=1)
        exact = np.abs(self.x).sum(axis=1).max(initial=0) < 1 << 24
        self.columns = self.x.T.astype(np.float32 if exact else np.float64)


def qualifying(x: np.ndarray, anchors: Anchors, eligible: np.ndarray, may: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, anchors and exact products of the eligible pairs that ``may`` never ruled out, and how many planes of pairs were summed.

    ``may(low, high, anchor)`` tells from intervals which pairs can still qualify; the arrays
    are of one shape or broadcast, and products end with equal bounds.
    """
    weights = plane_weights(anchors.bits)
    planes = bit_planes(x, anchors.bits)
    sums, live, summed = np.zeros(eligible.shape, np.int64), eligible, 0
    every = np.arange(len(anchors.x))[None, :]
    at = 0
    while at < len(weights) and live.size and live.mean() >= SPARSE:
        ones = np.unpackbits(planes[at].view(np.uint8), axis=1)[:, : x.shape[1]].astype(anchors.columns.dtype)
        sums += weights[at] * (ones @ anchors.columns).astype(np.int64)
        summed += live.size
        at += 1
        left = (1 << (len(weights) - at)) - 1
        live = live & may(sums + left * anchors.below, sums + left * anchors.above, every)
    r, c = np.nonzero(live)
    s = sums[r, c]
    for at in range(at, len(weights)):
        words = planes[at][r]
        for own, weight in zip(anchors.planes, weights):
            s += weights[at] * weight * np.bitwise_count(words & own[c]).sum(axis=1, dtype=np.int64)
        summed += len(r)
        left = (1 << (len(weights) - 1 - at)) - 1
        good = may(s + left * anchors.below[c], s + left * anchors.above[c], c)
        r, c, s = r[good], c[good], s[good]
    return r, c, s, summed


class BestLists:
    """The best ``size`` entries of many lists: highest scores first, ties by smaller keys."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.which, self.score, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The score that an entry must reach to enter each list.
        self.floor = np.full(lists, _LEAST)

    def add(self, which: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(which):
            return
        which, score, key = np.concatenate((self.which, which)), np.concatenate((self.score, score)), np.concatenate((self.key, key))
        order = np.lexsort((key, -score, which))
        which, score, key = which[order], score[order], key[order]
        begins = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        rank = np.arange(len(which)) - np.repeat(begins, np.diff(np.append(begins, len(which))))
        last = rank == self.size - 1
        self.floor[which[last]] = score[last]
        kept = rank < self.size
        self.which, self.score, self.key = which[kept], score[kept], key[kept]


def packed(vectors: DataFrame, factor: int, key: str, vector: str, label: str) -> DataFrame:
    """uid, key, label, ``x`` (binary, 32-bit integers) and ``bits`` (its longest component's) of every row that takes part."""
    ship(vectors.sparkSession)
    named = vectors.select(vectors[_quoted(key)].cast("long").alias("key"), vectors[_quoted(label)].alias("label"), vectors[_quoted(vector)].alias("vector")).where("key is not null and label is not null and vector is not null")
    kind = named.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(kept_vectors(batch.column("vector"))))
            sizes = np.array([len(v) for v in batch.column("vector")], np.int64)
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                x = scaled(own.column("vector"), factor)
                bits = [int(b).bit_length() for b in np.maximum(x, ~x).max(axis=1)]
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("label"), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()), pa.array(bits, pa.int32())], ["key", "label", "x", "bits"])

    return named.mapInArrow(run, f"key long, label {kind}, x binary, bits int").withColumn("uid", F.monotonically_increasing_id())


@dataclass
class Block:
    """The anchors of one scan, by the length of their vectors: numbers (in the block), and lists that a task fills for each."""

    rows: list  # uid, key, label, x

    def groups(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Anchors]]:
        """For every length of vectors: the length, and numbers, uids, labels and vectors of up to ``COLUMNS`` anchors."""
        sizes = np.array([len(r["x"]) for r in self.rows])
        for size in np.unique(sizes):
            numbers = np.flatnonzero(sizes == size)
            for at in range(0, len(numbers), COLUMNS):
                part = numbers[at : at + COLUMNS]
                x = np.stack([np.frombuffer(self.rows[i]["x"], "<i4") for i in part]).astype(np.int64)
                yield int(size), part, np.array([self.rows[i]["uid"] for i in part]), np.array([self.rows[i]["label"] for i in part], object), Anchors(x, bits)


def _best(stored: DataFrame, block: Block, bits: int, lists: int, size: int, same: bool, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """list, score, key: what each task found best for list ``anchor * lists + i``, of scores from ``low`` to ``high`` (a row per anchor).

    ``same``: rows of the anchor's label but the anchor itself; otherwise rows of another label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = list(block.groups(bits))
        best = BestLists(len(block.rows) * lists, size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = part.column("x").to_pylist()
                lengths = np.array([len(v) for v in values])
                keys, uids = (part.column(c).to_numpy() for c in ("key", "uid"))
                labels = np.array(part.column("label").to_pylist(), object)
                for length, numbers, anchor_uids, anchor_labels, anchors in groups:
                    rows = np.flatnonzero(lengths == length)
                    if not len(rows):
                        continue
                    x = np.frombuffer(b"".join(values[i] for i in rows), "<i4").reshape(len(rows), -1).astype(np.int64)
                    equal = (labels[rows][:, None] == anchor_labels[None, :]).astype(bool)
                    eligible = equal & (uids[rows][:, None] != anchor_uids[None, :]) if same else ~equal

                    def may(least: np.ndarray, most: np.ndarray, c: np.ndarray, numbers=numbers) -> np.ndarray:
                        n = numbers[c]
                        return reduce(np.logical_or, [(most >= np.maximum(low[n, i], best.floor[n * lists + i])) & (least <= high[n, i]) for i in range(lists)])

                    r, c, s, _ = qualifying(x, anchors, eligible, may)
                    for i in range(lists):
                        n = numbers[c]
                        good = (s >= np.maximum(low[n, i], best.floor[n * lists + i])) & (s <= high[n, i])
                        best.add(n[good] * lists + i, s[good], keys[rows[r[good]]])
        yield pa.RecordBatch.from_arrays([pa.array(best.which), pa.array(best.score), pa.array(best.key)], ["list", "score", "key"])

    found = stored.mapInArrow(run, "list long, score long, key long")
    order = [F.desc("score"), F.asc("key")]
    first = Window.partitionBy("list", F.pmod(F.xxhash64("key"), F.lit(PARTS))).orderBy(*order)  # a task's lists in parts: their number grows with the tasks
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order))).where(F.col("rank") <= size)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), factor: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label: its first ``negatives`` rows of other labels in the window.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Scores
    are products of vectors of ``floor(factor * x)``; higher ones come first, ties by smaller
    keys. A negative's score is from ``window[0]`` to ``window[1]`` percent of the positive's,
    both included. ``is_anchor`` is a condition on the columns ``key`` and ``label``.

    Rows with a null key, label or vector, a null or non-finite component or no component take
    no part; components must be smaller than 2**26 (an error otherwise). Rows of equal keys
    are rows of their own; vectors of different lengths have no product and are in none of
    each other's lists. Without anchors, positives or negatives there are no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    stored, path = spill(spark, packed(vectors, factor, key, vector, label))
    bits = stored.agg(F.max("bits")).first()[0] or 1
    anchors = stored.where(is_anchor)
    n = anchors.count()
    parts = 1 if n <= ANCHORS else -(-2 * n // ANCHORS)
    found = []
    for p in range(parts):
        rows = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == p).select("uid", "key", "label", "x").collect()  # about ANCHORS at most
        if rows:
            found.append(settled(spark, _of_block(stored, Block(rows), bits, positives, negatives, window)))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    forget(spark, path)
    return out


def _of_block(stored: DataFrame, block: Block, bits: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    spark, n = stored.sparkSession, len(block.rows)
    everything = np.full((n, 1), -_LEAST)
    told = _best(stored, block, bits, 1, positives, True, -everything, everything).collect()  # the positives of this block's anchors
    low, high = np.full((n, positives), -_LEAST), np.full((n, positives), _LEAST)  # no score is between these
    lists = []
    for r in told:
        i = r["rank"] - 1
        low[r["list"], i], high[r["list"], i] = -(-window[0] * r["score"] // 100), window[1] * r["score"] // 100
        lists.append((r["list"] * positives + i, block.rows[r["list"]]["key"], r["key"], r["score"]))
    best = _best(stored, block, bits, positives, negatives, False, low, high)
    known = spark.createDataFrame(lists, "list long, anchor_id long, positive_id long, positive_score long")  # a row per list of this block
    return best.join(F.broadcast(known), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("key") % 100 == 0)
