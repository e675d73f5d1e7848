"""Constraints: a check is a table of violations; ``require_empty`` runs it and raises."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.schema import CATEGORIES, MAX_TOKENS


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise ``ValueError`` with the first violation, if there is any."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def require_columns(frame: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def threshold_values(thresholds, categories: Iterable[str] = CATEGORIES) -> dict[str, float]:
    """One finite threshold of 0 or more per category, from a number, a mapping or a sequence in category order."""
    names = list(categories)
    if isinstance(thresholds, Mapping):
        missing = [c for c in names if c not in thresholds]
        if missing:
            raise ValueError(f"no threshold for {missing}")
        unknown = sorted(set(thresholds) - set(names))
        if unknown:
            raise ValueError(f"thresholds for unknown categories: {unknown}")
        values = {c: float(thresholds[c]) for c in names}
    elif isinstance(thresholds, (int, float)):
        values = dict.fromkeys(names, float(thresholds))
    else:
        given = [float(t) for t in thresholds]
        if len(given) != len(names):
            raise ValueError(f"{len(given)} thresholds for {len(names)} categories")
        values = dict(zip(names, given))
    wrong = {c: v for c, v in values.items() if not math.isfinite(v) or v < 0}
    if wrong:
        raise ValueError(f"thresholds must be finite and not negative: {wrong}")
    return values


def check_grid(grid: Iterable[float]) -> tuple[float, ...]:
    values = tuple(float(g) for g in grid)
    if not values or any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError("a threshold grid must rise strictly")
    return values


def chunk_violations(contracts: DataFrame, chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rows ``check, key`` for every broken rule of a window table; contracts have contract, split and text.

    Repeated ids, nulls, unknown contracts, other splits, offsets out of bounds, texts
    that are not the slice, token counts out of range, windows that do not advance, and
    text other than white space outside all windows.
    """
    order = Window.partitionBy("contract").orderBy("start", "end")
    around = chunks.withColumn("_last", F.lag("start").over(order)).withColumn("_reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.lead("start").over(order))
    names = ("contract", "split", "chunk_id", "start", "end", "text", "n_tokens", "_last", "_reach", "_next")
    listed = around.groupBy("contract").agg(F.collect_list(F.struct(*names)).alias("own"))  # a contract's windows meet its text once
    rows = listed.join(contracts.select("contract", F.col("split").alias("_split"), F.col("text").alias("_full")), "contract", "left")
    size = F.length("_full")
    part = lambda a, b: F.substring(F.col("_full"), (a + 1).cast("int"), (b - a).cast("int"))
    blank = lambda a, b: F.trim(F.regexp_replace(part(a, b), r"(?U)\s+", "")) == ""

    def broken_rules(x: Column) -> Column:
        reach = F.coalesce(x["_reach"], F.lit(0).cast("long"))
        conditions = (
            ("nulls", F.greatest(*(x[c].isNull().cast("int") for c in ("contract", "split", "start", "end", "text", "n_tokens"))) == 1),
            ("contract", F.col("_full").isNull()),
            ("split", x["split"] != F.col("_split")),
            ("bounds", (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > size)),
            ("text", ~x["text"].eqNullSafe(part(x["start"], x["end"]))),
            ("n_tokens", (x["n_tokens"] < 1) | (x["n_tokens"] > max_tokens)),
            ("advance", (x["start"] <= x["_last"]) | (x["end"] <= x["_reach"])),
            ("gap", (x["start"] > reach) & ~blank(reach, x["start"])),
            ("tail", x["_next"].isNull() & (F.greatest(x["end"], reach) < size) & ~blank(F.greatest(x["end"], reach), size.cast("long"))),
        )
        return F.struct(x["chunk_id"].alias("key"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions))).alias("checks"))

    repeated = chunks.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").select(F.lit("chunk_id").alias("check"), F.col("chunk_id").alias("key"))
    found = rows.select(F.explode(F.filter(F.transform("own", broken_rules), lambda t: F.size(t["checks"]) > 0)).alias("t"))
    broken = found.select(F.explode("t.checks").alias("check"), F.col("t.key").alias("key"))
    unseen = contracts.where(~F.col("text").rlike(r"(?U)^\s*$")).join(chunks.select("contract").distinct(), "contract", "left_anti").select(F.lit("missing").alias("check"), F.col("contract").alias("key"))
    return broken.unionByName(repeated).unionByName(unseen)


def prediction_violations(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Windows without a prediction, predictions without a window or repeated, and scores that are no probability."""
    expected, given = rows.select("chunk_id").distinct(), predictions.groupBy("chunk_id", "category").agg(F.count("*").alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.max(F.col("score").isNull() | F.isnan("score")).alias("void"))
    lacking = expected.join(given, "chunk_id", "left_anti").select(F.lit("missing").alias("check"), F.col("chunk_id").alias("key"))
    foreign = given.select("chunk_id").distinct().join(expected, "chunk_id", "left_anti").select(F.lit("unknown").alias("check"), F.col("chunk_id").alias("key"))
    wrong = given.where("n > 1 or void or hi > 1 or lo < 0").select(F.when(F.col("n") > 1, "repeated").otherwise("range").alias("check"), F.col("chunk_id").alias("key"))
    return lacking.unionByName(foreign).unionByName(wrong)


def label_violations(labeled: DataFrame) -> DataFrame:
    """Long labels that are masked and positive at once, repeated, or neither 0 nor 1."""
    key = F.concat_ws("|", "chunk_id", "category")
    both = labeled.where("label = 1 and not mask").select(F.lit("masked positive").alias("check"), key.alias("key"))
    odd = labeled.where("label is null or label not in (0, 1) or mask is null").select(F.lit("value").alias("check"), key.alias("key"))
    again = labeled.groupBy("chunk_id", "category").count().where("count > 1").select(F.lit("repeated").alias("check"), key.alias("key"))
    return both.unionByName(odd).unionByName(again)
