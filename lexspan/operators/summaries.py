"""Descriptive tables of contracts, spans, the presence grid and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.folds import ranked_within


def coverage(grid: DataFrame) -> DataFrame:
    """Per category: contracts that have it, and their share in per cent (one place)."""
    n = F.sum(F.col("has_clause").cast("long"))
    return grid.groupBy("category").agg(n.alias("n_contracts"), F.round(100 * n / F.count("*"), 1).alias("pct"))


def coverage_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coverage of two splits side by side with the distance in per cent points."""
    x, y = coverage(a).select("category", F.col("pct").alias("pct_a")), coverage(b).select("category", F.col("pct").alias("pct_b"))
    return x.join(y, "category", "left").withColumn("pct_gap", F.abs(F.col("pct_a") - F.col("pct_b")))


def length_stats(spans: DataFrame, size: Column) -> DataFrame:
    """Per category: count, median, mean and longest."""
    return spans.groupBy("category").agg(F.count("*").alias("n"), F.median(size).alias("median"), F.avg(size).alias("mean"), F.max(size).alias("longest"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column, in one row."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.75).alias("q75"), F.max(c).alias("max"))


def length_summary(rows: DataFrame, limit: int, length: str = "n_tokens", positives: str = "positives") -> DataFrame:
    """Token counts against a limit: mean (one place), median, tails, rows over it and the positives in these."""
    n, over = F.col(length), F.col(length) > limit
    cuts = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    one = rows.agg(F.round(F.avg(n), 1).alias("mean"), cuts.alias("p"), F.max(n).alias("longest"), F.sum(n).alias("total"), F.sum(over.cast("long")).alias("over_limit"), F.round(100 * F.sum(over.cast("long")) / F.count("*"), 2).alias("over_limit_pct"), F.sum(F.when(over, F.col(positives)).otherwise(0)).alias("positives_over_limit"))
    return one.select("mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "longest", "total", "over_limit", "over_limit_pct", "positives_over_limit")


def multiplicity(spans: DataFrame) -> DataFrame:
    """Per category, over contracts that have it: contracts, most, mean spans, and the share with more than one."""
    per = spans.groupBy("contract", "category").agg(F.count("*").alias("n"))
    return per.groupBy("category").agg(F.count("*").alias("contracts"), F.max("n").alias("most"), F.avg("n").alias("mean"), (100 * F.sum((F.col("n") > 1).cast("long")) / F.count("*")).alias("pct_multiple"))


def flag_rates(flagged: DataFrame) -> DataFrame:
    """Per category: spans, redacted ones and very short ones with their shares, in one pass."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return flagged.groupBy("category").agg(F.count("*").alias("n"), n("has_redaction").alias("redacted"), n("is_very_short").alias("short"), (100 * n("has_redaction") / F.count("*")).alias("pct_redacted"), (100 * n("is_very_short") / F.count("*")).alias("pct_short"))


def missing_histogram(grid: DataFrame) -> DataFrame:
    """How many contracts lack how many categories."""
    return grid.groupBy("contract").agg(F.sum((~F.col("has_clause")).cast("long")).alias("missing")).groupBy("missing").agg(F.count("*").alias("contracts"))


def split_summary(contracts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per split: contracts, spans, categories, median and longest text."""
    a = contracts.groupBy("split").agg(F.count("*").alias("contracts"), F.median("n_chars").alias("median_chars"), F.max("n_chars").alias("max_chars"))
    b = spans.groupBy("split").agg(F.count("*").alias("spans"), F.countDistinct("category").alias("categories"))
    return a.join(b, "split", "left")


def presence_pivot(grid: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """One row per contract, one 0/1 column per category (listed, so no extra pass finds them)."""
    out = grid.groupBy("contract").pivot("category", list(categories)).agg(F.first(F.col("has_clause").cast("int")))
    return out.select("contract", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c.lower().replace(" ", "_").replace("-", "_")) for c in categories))


def cooccurrence(grid: DataFrame) -> DataFrame:
    """Contracts that have both categories, for every pair. Pairs are made within a contract's own list of categories."""
    lists = grid.where("has_clause").groupBy("contract").agg(F.collect_set("category").alias("c"))
    pairs = lists.select(F.explode("c").alias("category_a"), "c").select("category_a", F.explode("c").alias("category_b"))
    return pairs.groupBy("category_a", "category_b").agg(F.count("*").alias("n_contracts"))


def density(contracts: DataFrame, grid: DataFrame) -> DataFrame:
    """Length and number of categories of each contract."""
    present = grid.groupBy("contract").agg(F.sum(F.col("has_clause").cast("long")).alias("n_present"))
    return contracts.select("contract", "n_chars").join(present, "contract")


def quantile_sample(contracts: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """The contracts at the rounded (half to even) ranks of some quantiles by length, then name.

    Ranks are found from counts per length, and only contracts of the lengths that hold
    them are ordered.
    """
    counts = contracts.groupBy("n_chars").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per length
    total = contracts.count()
    ranks = sorted({round((total - 1) * q) for q in quantiles}) if total else []
    wanted = F.array(*(F.lit(r).cast("long") for r in ranks)) if ranks else F.array().cast("array<bigint>")
    held = before.withColumn("rank", F.explode(wanted)).where("rank >= before and rank < before + n").select("n_chars", "before", "rank", "n")
    sizes = {r["n_chars"]: r["n"] for r in held.select("n_chars", "n").distinct().collect()}  # a row per quantile at most
    if not sizes:
        return contracts.limit(0).select(F.lit(0).cast("long").alias("rank"), "contract", "n_chars")
    inside = contracts.join(F.broadcast(held.select("n_chars", "before").distinct()), "n_chars")
    inside = ranked_within(inside, "n_chars", "contract", sizes).withColumn("place", F.col("before") + F.col("r"))
    return inside.join(F.broadcast(held.select("rank")), F.col("place") == F.col("rank")).select(F.col("rank"), "contract", "n_chars")
