"""Paired bootstrap over contracts, and the decisions that rest on it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators.checks import require_empty
from lexspan.operators.metrics import SCALE, fixed, ratio
from lexspan.schema import WEAK_CATEGORIES
from lexspan.session import settled, ship

# The order in which equal fixes are preferred, and the control.
FIXES = ("pos_weight", "focal", "downsample")
CONTROL = "bce"
# End of fixed values.


def contract_counts(decided: DataFrame, arm: str = "arm") -> DataFrame:
    """What a resampled contract adds: per arm, contract and category the true and false positives and false negatives."""
    y, d = F.col("label"), F.col("decision")
    return decided.where("mask").groupBy(arm, "contract", "category").agg(F.sum(y * d).alias("tp"), F.sum((1 - y) * d).alias("fp"), F.sum(y * (1 - d)).alias("fn"))


def weight_bounds() -> list[int]:
    """A draw of 32 bits at or above the k-th of these makes a weight above k: the Poisson distribution of mean 1."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        out.append(int(total * 2**32))
        term /= k + 1
    return out


def resampled_sums(counts: DataFrame, samples: int, seed: int = 42) -> DataFrame:
    """arm, sample, category, tp, fp, fn: each sample's sums of ``contract_counts``, with the data as they are as sample -1.

    A contract's weight in a sample is a Poisson number of mean 1, made from the bits of
    ``md5("seed:contract:block")``, a block for every four samples. So weights are made where
    the counts are, are the same in any order and on any engine, and no draws are shuffled:
    a task multiplies the matrix of its contracts' weights with that of their counts. The sums
    are stored, so that they are drawn once, whatever is asked of them.
    """
    spark = counts.sparkSession
    ship(spark)
    fields = ("tp", "fp", "fn")
    by_contract = counts.groupBy("contract").agg(F.collect_list(F.struct("arm", "category", *fields)).alias("c"))
    blocks = -(-samples // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, md5 = np.array(weight_bounds()), hashlib.md5
        ends = [str(b).encode() for b in range(blocks)]
        place: dict[tuple[str, str], int] = {}
        seen: set[int] = set()
        sums = np.zeros((samples + 1, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = b"".join([md5(start + end).digest() for start in [f"{seed}:{contract}:".encode() for contract in part.column("contract").to_pylist()] for end in ends])
                weights = np.ones((part.num_rows, samples + 1))  # the last: the data as they are
                weights[:, :samples] = np.searchsorted(bounds, np.frombuffer(raw, ">u4").reshape(part.num_rows, 4 * blocks)[:, :samples], "right")
                own = part.column("c")
                rows = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy())
                entries = own.flatten()
                arm, category = (entries.field(f).dictionary_encode("encode") for f in ("arm", "category"))
                names = [(a, c) for a in arm.dictionary.to_pylist() for c in category.dictionary.to_pylist()]
                for key in names:
                    place.setdefault(key, len(place))
                known = np.array([place[key] for key in names], np.int64)
                k = known[arm.indices.to_numpy().astype(np.int64) * len(category.dictionary) + category.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
                values = np.zeros((part.num_rows, 3 * len(place)))
                for f, name in enumerate(fields):
                    values[rows, 3 * k + f] = entries.field(name).to_numpy()
                sums = np.pad(sums, ((0, 0), (0, values.shape[1] - sums.shape[1]))) + weights.T @ values  # whole numbers below 2**53
                seen.update(k.tolist())
        for (arm, category), k in place.items():
            if k in seen:
                own = [pa.array(sums[:, 3 * k + f].astype(np.int64)) for f in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([arm] * (samples + 1)), pa.array([*range(samples), -1]), pa.array([category] * (samples + 1)), *own], ["arm", "sample", "category", *fields])

    drawn = by_contract.mapInArrow(run, "arm string, sample long, category string, tp long, fp long, fn long")
    return settled(spark, drawn.groupBy("arm", "sample", "category").agg(*(F.sum(f).alias(f) for f in fields)))


def _sample_means(counts: DataFrame, samples: int, seed: int, weak: tuple[str, ...]) -> DataFrame:
    """Per arm and sample: macro F1 and mean F1 of the weak categories."""
    return _means(resampled_sums(counts, samples, seed), weak, "arm", "sample")


def _means(sums: DataFrame, weak: tuple[str, ...], *keys: str) -> DataFrame:
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    rows = sums.select(*keys, "category", F.coalesce(f1, F.lit(0.0)).alias("f1"))
    mean = lambda keep: F.sum(F.when(keep, fixed(F.col("f1")))) / (F.sum(keep.cast("long")) * F.lit(SCALE).cast("long"))
    return rows.groupBy(*keys).agg(mean(F.lit(True)).alias("macro_f1"), mean(F.col("category").isin(*weak)).alias("weak_f1"))


def arm_means(decided: DataFrame, weak: tuple[str, ...] = WEAK_CATEGORIES) -> DataFrame:
    """arm, macro_f1, weak_f1 of the data as they are: what ``choose_arm`` compares."""
    counts = contract_counts(decided).groupBy("arm", "category").agg(*(F.sum(f).alias(f) for f in ("tp", "fp", "fn")))
    return _means(counts, weak, "arm")


def paired_bootstrap(decided: DataFrame, samples: int = 2000, seed: int = 42, weak: tuple[str, ...] = WEAK_CATEGORIES) -> DataFrame:
    """arm_a, arm_b, metric, difference, ci_low, ci_high of every pair of arms (in name order), on the same draws.

    ``decided`` has an ``arm`` column. Contracts are the unit; counts per contract come
    first, so the draws multiply contracts, not windows. The interval is the 2.5th to the
    97.5th percentile, interpolated linearly.
    """
    counts = contract_counts(decided)
    means = _sample_means(counts, samples, seed, weak)
    long = means.select("arm", "sample", F.explode(F.array(F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")), F.struct(F.lit("weak_f1").alias("metric"), F.col("weak_f1").alias("value")))).alias("m")).select("arm", "sample", "m.metric", "m.value")
    left, right = long.withColumnRenamed("arm", "arm_a").withColumnRenamed("value", "a"), long.withColumnRenamed("arm", "arm_b").withColumnRenamed("value", "b")
    pairs = left.join(right, ["sample", "metric"]).where("arm_a < arm_b").withColumn("d", F.col("a") - F.col("b"))
    return _intervals(pairs, "arm_a", "arm_b", "metric")


def _intervals(differences: DataFrame, *keys: str) -> DataFrame:
    drawn = F.when(F.col("sample") >= 0, F.col("d"))
    bounds = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    return differences.groupBy(*keys).agg(F.max(F.when(F.col("sample") < 0, F.col("d"))).alias("difference"), bounds.alias("ci")).select(*keys, "difference", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def contract_intervals(decided: DataFrame, base: str, other: str, samples: int = 2000, seed: int = 42) -> DataFrame:
    """comparison, category (and macro), ci_low, ci_high of F1 differences between two arms on contract-level decisions."""
    counts = contract_counts(decided.where(F.col("arm").isin(base, other)))
    sums = resampled_sums(counts, samples, seed).where("sample >= 0")
    f1 = sums.select("arm", "sample", "category", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    macro = f1.groupBy("arm", "sample").agg(F.lit("macro avg").alias("category"), (F.sum(fixed(F.col("f1"))) / (F.count("*") * F.lit(SCALE).cast("long"))).alias("f1"))
    both = f1.unionByName(macro.select("arm", "sample", "category", "f1"))
    a, b = both.where(F.col("arm") == other).select("sample", "category", F.col("f1").alias("a")), both.where(F.col("arm") == base).select("sample", "category", F.col("f1").alias("b"))
    ci = F.percentile(F.col("a") - F.col("b"), F.array(F.lit(0.025), F.lit(0.975)))
    return a.join(b, ["sample", "category"]).groupBy("category").agg(ci.alias("ci")).select(F.lit(f"{other} - {base}").alias("comparison"), "category", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def clear_wins(pairs: DataFrame) -> DataFrame:
    """winner, loser, metric of the comparisons whose interval leaves out 0, whichever way round they are listed."""
    sides = F.when(F.col("ci_low") > 0, F.struct(F.col("arm_a").alias("winner"), F.col("arm_b").alias("loser"))).when(F.col("ci_high") < 0, F.struct(F.col("arm_b").alias("winner"), F.col("arm_a").alias("loser")))
    return pairs.select(sides.alias("s"), "metric").where("s is not null").select("s.winner", "s.loser", "metric")


def _contenders(arms: DataFrame, wins: DataFrame, metric: str) -> DataFrame:
    """The arms (arm, place, and their means) that the leader on ``metric`` does not clearly beat, with ``leader``."""
    lead = arms.agg(F.max_by("arm", F.struct(F.col(metric), -F.col("place"))).alias("leader"))
    beaten = wins.where(F.col("metric") == metric).select(F.col("winner").alias("leader"), F.col("loser").alias("arm"))
    return arms.drop("leader").crossJoin(lead).join(beaten, ["leader", "arm"], "left_anti")  # one leader


def choose_arm(summary: DataFrame, pairs: DataFrame, fixes: tuple[str, ...] = FIXES, control: str = CONTROL) -> DataFrame:
    """One row: the fix to take, how it was decided, the leaders and those level with them, and how it stands to the control.

    A fix that clearly beats the others on macro F1 is taken (``macro_f1``); else, of those
    level with the leader, one that clearly beats the rest on the weak categories
    (``weak_f1``); else the first of these in the order of ``fixes`` (``simplicity``).
    ``summary``: arm, macro_f1, weak_f1; ``pairs``: ``paired_bootstrap``, where every two of
    the arms must be listed once for each metric. ``*_against_control``: 1 clearly better,
    -1 clearly worse, 0 neither, null without a control.
    """
    spark = summary.sparkSession
    order = spark.createDataFrame([(a, i) for i, a in enumerate((*fixes, control))], "arm string, place int")
    arms = summary.join(F.broadcast(order), "arm")  # a row per arm
    listed = pairs.groupBy(F.least("arm_a", "arm_b").alias("one"), F.greatest("arm_a", "arm_b").alias("other"), "metric").agg(F.count("*").alias("n"))
    metrics = spark.createDataFrame([("macro_f1",), ("weak_f1",)], "metric string")
    due = arms.select(F.col("arm").alias("one")).crossJoin(arms.select(F.col("arm").alias("other"))).where("one < other").crossJoin(metrics)
    require_empty(due.join(listed, ["one", "other", "metric"], "left").where("n is null or n <> 1"), "every two arms need one row for each metric")
    wins = clear_wins(pairs)
    tied = _contenders(arms.where(F.col("arm") != control), wins, "macro_f1")
    left = _contenders(tied, wins, "weak_f1")
    names = lambda rows, name: rows.agg(F.max("leader").alias(f"{name}_leader"), F.transform(F.array_sort(F.collect_list(F.struct("place", "arm"))), lambda x: x["arm"]).alias(f"{name}_level"))
    out = names(tied, "macro_f1").crossJoin(names(left, "weak_f1"))  # a row each
    how = F.when(F.size("macro_f1_level") == 1, "macro_f1").when(F.size("weak_f1_level") == 1, "weak_f1").otherwise("simplicity")
    out = out.select(F.get("weak_f1_level", F.lit(0)).alias("pick"), how.alias("decided_by"), "macro_f1_leader", "macro_f1_level", "weak_f1_leader", "weak_f1_level")
    for metric in ("macro_f1", "weak_f1"):
        against = wins.where(F.col("metric") == metric).select(F.when(F.col("loser") == control, F.col("winner")).when(F.col("winner") == control, F.col("loser")).alias("pick"), F.when(F.col("loser") == control, 1).otherwise(-1).alias("sign"))
        known = arms.where(F.col("arm") == control).select(F.lit(0).alias("level"))
        out = out.join(against.where("pick is not null"), "pick", "left").join(known, F.lit(True), "left").withColumn(f"{metric}_against_control", F.coalesce("sign", "level")).drop("sign", "level")
    return out


def select_config(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """The leader on macro F1 if clear, else of those not clearly worse that with the fewest epochs, then the lowest rate.

    ``summary``: config (name), macro_f1, epochs, learning_rate. ``pairs``: paired_bootstrap of the configurations.
    """
    lead = summary.agg(F.max_by("config", F.struct("macro_f1", -F.col("epochs"), -F.col("learning_rate"))).alias("leader"))
    macro = pairs.where("metric = 'macro_f1'")
    worse = macro.join(F.broadcast(lead), (F.col("arm_a") == F.col("leader")) & (F.col("ci_low") > 0)).select(F.col("arm_b").alias("config"))  # one row
    worse = worse.unionByName(macro.join(F.broadcast(lead), (F.col("arm_b") == F.col("leader")) & (F.col("ci_high") < 0)).select(F.col("arm_a").alias("config")))
    tied = summary.join(worse, "config", "left_anti")
    return tied.agg(F.min(F.struct("epochs", "learning_rate", "config")).alias("m"), F.count("*").alias("tied")).select(F.col("m.config").alias("pick"), F.col("m.epochs").alias("epochs"), F.col("m.learning_rate").alias("learning_rate"), "tied")


def config_name(learning_rate: float, epochs: int) -> str:
    return f"lr{learning_rate:g}-ep{epochs}"


def parsed_config(name: Column) -> Column:
    """The rate and the epochs that a configuration's name says; null if it is no such name."""
    rate, epochs = (F.regexp_extract(name, r"^lr([0-9.e+-]+)-ep([0-9]+)$", i) for i in (1, 2))
    return F.struct(F.when(rate != "", rate.cast("double")).alias("learning_rate"), F.when(epochs != "", epochs.cast("int")).alias("epochs"))


def seed_summary(runs: DataFrame, *values: str, by: str = "config") -> DataFrame:
    """Mean and spread over the seeds of each configuration: ``<value>_mean``, ``<value>_std`` (null for one seed), ``seeds``."""
    figures = [f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return runs.groupBy(by).agg(F.count("*").alias("seeds"), *figures)
