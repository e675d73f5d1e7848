"""Windows as rows of token ids of fixed size, for training; and the arms that training compares."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators.checks import require_columns, require_empty
from lexspan.operators.metrics import positive_weights
from lexspan.schema import TOKEN_LIMIT
from lexspan.session import forget, ship, spill

#: Rows are padded to the next multiple of this many ids.
BUCKET = 64


def encode(rows: DataFrame, tokenizer: str, max_length: int = TOKEN_LIMIT, begin: int | None = None, end: int | None = None, pad: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (chunk_id, text, ...) with ``n_tokens``, ``size``, ``ids`` and ``attention`` (arrays of ``size``: 1 for tokens, 0 for padding).

    ``tokenizer`` is the path of a tokenizer file; ``begin`` and ``end`` are ids to put around
    every row. ``size`` is the next multiple of ``bucket`` (at most ``max_length``), so that
    rows of one size make a batch without padding. Nothing is cut: rows with more than
    ``max_length`` ids, with null or blank texts, or ids that stand twice are refused, with one
    of them named. The rows keep their columns.
    """
    spark = rows.sparkSession
    ship(spark)
    require_columns(rows, "chunk_id", "text")
    blank = F.max(F.col("text").isNull() | (F.trim("text") == "")).alias("without_text")
    require_empty(rows.groupBy("chunk_id").agg(F.count("*").alias("count"), blank).where("without_text or count > 1 or chunk_id is null"), "rows without text, or without ids of their own")
    around = (begin is not None) + (end is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        told = Tokenizer.from_file(tokenizer)
        told.no_truncation()
        told.no_padding()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [e.ids for e in told.encode_batch_fast(part.column("text").to_pylist(), add_special_tokens=False)]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                counts = lengths + around
                sizes = np.where(counts > max_length, counts, np.minimum(-(-counts // bucket) * bucket, max_length))
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                begins, total = offsets[:-1], int(offsets[-1])
                inside = np.arange(total) - np.repeat(begins, sizes)  # an id's place in its row
                attention = inside < np.repeat(counts, sizes)
                ids = np.full(total, pad, np.int32)
                first = begin is not None
                ids[(inside >= first) & (inside < np.repeat(lengths + first, sizes))] = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))
                if begin is not None:
                    ids[begins] = begin
                if end is not None:
                    ids[begins + counts - 1] = end
                at = pa.array(offsets.astype(np.int32))
                columns = {name: part.column(name) for name in part.schema.names} | {"n_tokens": pa.array(counts.astype(np.int32)), "size": pa.array(sizes.astype(np.int32)), "ids": pa.ListArray.from_arrays(at, pa.array(ids)), "attention": pa.ListArray.from_arrays(at, pa.array(attention.astype(np.int8)))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    new = "n_tokens int, size int, ids array<int>, attention array<tinyint>"
    kept = rows.drop("n_tokens", "size", "ids", "attention")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out, path = spill(spark, kept.mapInArrow(run, f"{fields}, {new}"))
    long = out.where(F.col("n_tokens") > max_length).select("chunk_id", "n_tokens").limit(1).collect()
    if long:
        forget(spark, path)
        raise ValueError(f"rows of more than {max_length} ids: {long[0].asDict()}")
    return out


@dataclass(frozen=True)
class Arm:
    """A way to deal with few positives: the loss, and whether negatives are drawn anew for each epoch."""

    loss: str
    weighted: bool = False
    downsampled: bool = False


# The arms that are compared.
ARMS = {"bce": Arm("bce"), "pos_weight": Arm("bce", weighted=True), "focal": Arm("focal"), "downsample": Arm("bce", downsampled=True)}
# End of fixed values.


def arm_losses(rows: DataFrame, train: DataFrame, arms: tuple[str, ...] = tuple(ARMS)) -> DataFrame:
    """arm, category, loss: what every arm's loss says of ``rows`` (category, label, mask, logit); weights come from ``train``'s labels.

    Losses are means over unmasked rows. Fails on arms that are not known.
    """
    from lexspan.operators.metrics import masked_bce, masked_focal

    unknown = sorted(set(arms) - set(ARMS))
    if unknown:
        raise ValueError(f"unknown arms: {unknown}")
    weights = {r["category"]: r["weight"] for r in positive_weights(train).collect()} if any(ARMS[a].weighted for a in arms) else {}  # a row per category
    out = None
    for name in arms:
        arm = ARMS[name]
        told = masked_focal(rows, 2.0, 0.25, "category") if arm.loss == "focal" else masked_bce(rows, weights if arm.weighted else None, "category")
        told = told.select(F.lit(name).alias("arm"), "category", "loss")
        out = told if out is None else out.unionByName(told)
    return out
