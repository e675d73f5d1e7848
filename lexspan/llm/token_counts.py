"""Exact token counts of every prefix of a text, by prefix dynamic programming."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import bpe
from lexspan.llm.blocks import TextBlock, quoted, text_blocks
from lexspan.session import ship, table

TOKEN_LIMIT = 512


class PrefixCounts:
    """Token counts of all prefixes of one text: asked by length or by budget, never encoding the text again.

    Kept: where each piece starts and the tokens before it. Within a piece, and where
    a cut changes how the text's last white space or contraction is split, the counts
    come from the pass over that piece alone. Texts with a special token's string are
    split at it; such a string counts as one token.
    """

    def __init__(self, vocab: bpe.Vocabulary, text: str | None):
        self.vocab = vocab
        self.text = text or ""
        self.starts: list[int] = []
        self.before: list[int] = []
        self.fixed: list[bool] = []  # a special token
        total = 0
        for at, part, special in self._parts(self.text):
            for start, piece in [(0, part)] if special else self._pieces(part):
                self.starts.append(at + start)
                self.before.append(total)
                self.fixed.append(special)
                total += 1 if special else vocab.prefix_counts(piece.encode())[-1]
        self.total = total

    def _parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        at = 0
        while at < len(text):
            hits = [(p, -len(s), s) for s in self.vocab.special if (p := text.find(s, at)) >= 0]
            if not hits:
                yield at, text[at:], False
                return
            p, _, s = min(hits)
            if p > at:
                yield at, text[at:p], False
            yield p, s, True
            at = p + len(s)

    @staticmethod
    def _pieces(text: str) -> list[tuple[int, str]]:
        block = TextBlock(pa.array([text]))
        starts = np.searchsorted(bpe.code_points(block)[1], bpe.pieces(block)[0]).tolist()
        return [(a, text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)])]

    def count(self, length: int) -> int:
        """Tokens of the first ``length`` characters."""
        if length >= len(self.text):
            return self.total
        if length <= 0:
            return 0
        i = bisect.bisect_right(self.starts, length - 1) - 1
        i = max(0, i - 1)  # the cut may end the look-ahead of the piece before
        if self.fixed[i]:
            i = min(i + 1, len(self.starts) - 1)
            if self.starts[i] >= length:
                return self.before[i]
        rest = self.text[self.starts[i] : length]
        return self.before[i] + sum(1 if special else sum(self.vocab.prefix_counts(p.encode())[-1] for _, p in self._pieces(part)) for _, part, special in self._parts(rest))

    def within(self, budget: int) -> int:
        """The longest prefix, in characters, such that it and all shorter ones at piece starts have at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        i = max(0, bisect.bisect_right(self.before, budget) - 1)
        length = self.starts[i]
        stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
        while length < stop and self.count(length + 1) <= budget:
            length += 1
        return length


def count_tokens(docs: DataFrame, vocabulary: str, budget: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and, with a budget, ``fits_chars``.

    ``fits_chars`` is the longest prefix (characters) within the budget. A null or
    empty text has no bytes and no tokens. Null or repeated keys are rows like any
    other. Other columns are not read. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    kind = named.schema["key"].dataType
    names = ["key", "n_bytes", "n_tokens", *(["fits_chars"] if budget is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocabulary)
        store = bpe.store_of(vocab, "counts", lambda found: [np.array([vocab.prefix_counts(p)[-1]], np.uint32) for p in found])
        for batch, block in text_blocks(batches):
            starts, firsts = bpe.pieces(block)
            slots = store.find(block.data, starts, np.append(starts[1:], len(block.data)))
            sums = np.concatenate(([0], np.cumsum(store.flat[slots].astype(np.int64))))
            totals = sums[firsts[1:]] - sums[firsts[:-1]]
            for i in np.flatnonzero(~bpe.plain(block, vocab.special)):
                totals[i] = PrefixCounts(vocab, block.texts[int(i)].as_py()).total
            out = [batch.column("key"), pa.array(block.lengths), pa.array(totals)]
            if budget is not None:
                chars = pc.fill_null(pc.utf8_length(block.texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in np.flatnonzero(totals > budget):
                    chars[i] = PrefixCounts(vocab, block.texts[int(i)].as_py()).within(budget)
                out.append(pa.array(chars))
            yield pa.RecordBatch.from_arrays(out, names)

    return named.mapInArrow(run, f"key {kind.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:])).withColumnRenamed("key", key)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
