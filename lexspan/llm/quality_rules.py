"""Quality rules: per-text counts, and lines that too many documents of one host share.

A line is normalised (A to Z lower-cased, words joined by one space) and hashed. For each
host the documents that hold a line are counted, each once. A line held by more than
``limit`` documents of a host is taken out of every document there, however many the
host has; a document left with less than ``keep_share`` of its words is depleted and
rejected. So documents of which a host holds more than ``limit`` copies go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import LOWER, SPACED, TextBlock, byte_table, mix, quoted, run_hashes, text_blocks, window_hashes, word_hashes
from lexspan.session import forget, settled, ship, spill, table

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = ~byte_table((0x0A, 0x0A))
#: A table of frequent lines up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16


def _per_document(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[firsts[1:]] - sums[firsts[:-1]]


class Counts:
    """The counts of a block, an array each with one figure per document, and its lines."""

    def __init__(self, block: TextBlock):
        data, n = block.data, block.n
        starts, ends, firsts = block.words(SPACED)
        self.n_words = np.diff(firsts)
        size = np.arange(n)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.word_chars = _per_document(chars[ends] - chars[starts], firsts)
        self.n_symbols = _per_document(_SYMBOLS[data], block.starts)
        # lines with a word; those of only line breaks and white space have none
        line_start, line_end, line_firsts = block.words(_BREAK)
        word_from, word_to = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
        real = word_to > word_from
        line_doc = np.repeat(size, np.diff(line_firsts))[real]
        line_start, line_end, word_from, word_to = line_start[real], line_end[real], word_from[real], word_to[real]
        exact = word_hashes(data, line_start, line_end)
        distinct = np.unique(exact ^ mix(line_doc.astype(np.uint64)), return_index=True)[1]
        lines, different = np.bincount(line_doc, minlength=n), np.bincount(line_doc[distinct], minlength=n)
        self.n_dup_lines = lines - different
        # windows of three words found again
        hashes = word_hashes(data, starts, ends)
        self.n_repeat_words = np.zeros(n, np.int64)
        if len(starts) >= 3:
            doc = np.repeat(size, self.n_words)
            windows = window_hashes(hashes, 3) ^ mix(doc[2:].astype(np.uint64))
            within = np.flatnonzero(doc[2:] == doc[:-2])
            _, back, times = np.unique(windows[within], return_inverse=True, return_counts=True)
            again = within[times[back] > 1]
            marked = np.zeros(len(starts), bool)
            for j in range(3):
                marked[again + j] = True
            self.n_repeat_words = _per_document(marked, firsts)
        # normalised lines: hash and words, each once a document
        lowered = word_hashes(LOWER[data], starts, ends)
        normal = run_hashes(lowered, word_from, word_to)
        order = np.lexsort((normal, line_doc))
        key_doc, key = line_doc[order], normal[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key_doc[1:] != key_doc[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(fresh)
        self.line_hash = key[at].view(np.int64)
        self.line_words = np.add.reduceat((word_to - word_from)[order], at) if len(at) else np.zeros(0, np.int64)
        self.line_firsts = np.searchsorted(key_doc[at], np.arange(n + 1))


def line_counts(docs: DataFrame) -> DataFrame:
    """Per row: a row number, the key, host, the base counts and the normalised lines."""
    ship(docs.sparkSession)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("key", "host")}
    schema = f"row long, key {kinds['key']}, host {kinds['host']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch, block in text_blocks(batches):
            c = Counts(block)
            stops = pa.array(c.line_firsts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + block.n)), batch.column("key"), batch.column("host"), *(pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)), *(pa.ListArray.from_arrays(stops, pa.array(x)) for x in (c.line_hash, c.line_words))],
                ["row", "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )
            row += block.n

    return docs.mapInArrow(run, schema)


def apply_rules(docs: DataFrame, limit: int = 10, keep_share: float = 0.5, least_words: int = 50, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """Per row of ``docs``: key, the base counts, ``base_failed``, ``frequent_words`` (in lines taken out) and ``kept``.

    A null or empty text has no words, fails the base rules and is not kept. Rows with
    a null host form one host. Rows with repeated or null keys or equal texts are
    documents like any other. An empty table gives an empty result; other columns are
    not read, whatever their names. The counts and hashed lines are stored once in the
    shared folder; what is shuffled is one small row for each line of a document, summed
    before it is sent.
    """
    spark = docs.sparkSession
    named = docs.select(*(docs[quoted(c)].alias(to) for c, to in ((key, "key"), (host, "host"), (text, "text"))))
    stored, path = spill(spark, line_counts(named))
    lines = stored.select("row", F.coalesce(F.col("host").cast("string"), F.lit("\u0000")).alias("at"), F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("row", "at", F.col("l.line_hash").alias("hash"), F.col("l.line_words").alias("words"))
    frequent = lines.groupBy("at", "hash").agg(F.count("*").alias("held")).where(F.col("held") > limit).select("at", "hash")
    frequent, frequent_path = spill(spark, frequent)
    if frequent.count() <= BROADCAST_ROWS:
        held = lines.join(F.broadcast(frequent), ["at", "hash"])
    else:  # a line of a third of all documents goes to many tasks
        dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["at", "hash", "salt"])
    lost = held.groupBy("row").agg(F.sum("words").alias("frequent_words"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = stored.select("row", "key", *counts).join(lost, "row", "left").withColumn("frequent_words", F.coalesce("frequent_words", F.lit(0)))
    out = settled(spark, judged.select(F.col("key").alias(key), *counts, "frequent_words", failed.alias("base_failed"), (~failed & (F.col("n_words") - F.col("frequent_words") >= keep_share * F.col("n_words"))).alias("kept")))
    forget(spark, path, frequent_path)
    return out


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "frequent_words")
