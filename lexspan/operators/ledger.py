"""A ledger of training runs in folders, and what is decided from it.

A run is an arm on a fold. Its predictions are written first, its own row last, both in the
partition (arm, fold) and over whatever an earlier attempt left there, so a run that was
killed is not in the ledger and a run that is repeated replaces itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import bootstrap, metrics
from lexspan.operators.checks import require_empty
from lexspan.schema import CATEGORIES, FINE_GRID, TUNING_GRID, WEAK_CATEGORIES
from lexspan.session import forget, spill

RUNS = "arm string, fold int, smoke boolean, labels_digest string, folds_digest string, epochs int, learning_rate double, seconds double, loss double"
PREDICTIONS = "arm string, fold int, chunk_id string, probabilities array<double>"


def record(path: str, runs: DataFrame, predictions: DataFrame) -> None:
    """Add runs, or replace those of the same arm and fold; all else in the ledger stays as it is."""
    for kind, frame in (("predictions", predictions), ("runs", runs)):
        frame.write.partitionBy("arm", "fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{kind}")


def read(spark: SparkSession, paths: list[str], labels_digest: str, folds_digest: str) -> tuple[DataFrame, DataFrame]:
    """Runs and their predictions from several ledgers.

    Fails without runs, on smoke runs, on a run that is in two ledgers, and on runs made from
    other labels or folds. Predictions without a run (of attempts that did not end) are left out.
    """
    both = []
    for kind, schema in (("runs", RUNS), ("predictions", PREDICTIONS)):
        both.append(reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{p}/{kind}") for p in paths]))
    runs, predictions = both
    if runs.isEmpty():
        raise ValueError("no finished runs")
    require_empty(runs.where(F.coalesce("smoke", F.lit(True))), "smoke runs are no results")
    require_empty(runs.groupBy("arm", "fold").count().where("count > 1"), "two results for one run")
    require_empty(runs.where(~F.col("labels_digest").eqNullSafe(F.lit(labels_digest)) | ~F.col("folds_digest").eqNullSafe(F.lit(folds_digest))), "a run used other labels or folds")
    return runs, predictions.join(F.broadcast(runs.select("arm", "fold")), ["arm", "fold"], "left_semi")  # a row per run


def complete_folds(runs: DataFrame, arms: DataFrame) -> DataFrame:
    """``fold``s that every arm (column ``arm``) has finished: relational division."""
    due = arms.select("arm").distinct()
    done = runs.join(due, "arm", "left_semi").groupBy("fold").agg(F.countDistinct("arm").alias("n"))
    return done.crossJoin(due.agg(F.count("*").alias("all"))).where("n = all and n > 0").select("fold")  # one row


def complete_arms(runs: DataFrame, folds: DataFrame) -> DataFrame:
    """``arm``s that have finished every fold."""
    return complete_folds(runs.select(F.col("fold").alias("arm"), F.col("arm").alias("fold")), folds.select(F.col("fold").alias("arm"))).select(F.col("fold").alias("arm"))


def ignored_runs(runs: DataFrame, folds: DataFrame) -> DataFrame:
    """arm, fold of runs on folds that not all arms have finished."""
    return runs.join(F.broadcast(folds), "fold", "left_anti").select("arm", "fold")  # a row per fold


def _by_window(rows: DataFrame) -> DataFrame:
    """contract, chunk_id, fold and ``v``, the window's entries with their place (``at``) in ``CATEGORIES``.

    From rows by category, or from rows with ``labels`` and ``label_mask`` in category order.
    """
    names = F.array(*(F.lit(c) for c in CATEGORIES))
    if "labels" in rows.columns:
        entry = lambda x, i: F.struct(F.element_at(names, i + 1).alias("category"), i.alias("category_idx"), x["labels"].alias("label"), x["label_mask"].alias("mask"), i.alias("at"))
        return rows.select("contract", "chunk_id", "fold", F.transform(F.arrays_zip("labels", "label_mask"), entry).alias("v"))
    placed = rows.withColumn("at", (F.array_position(names, F.col("category")) - 1).cast("int"))
    return placed.groupBy("contract", "chunk_id", "fold").agg(F.collect_list(F.struct("category", "category_idx", "label", "mask", "at")).alias("v"))


def _decided(rows: DataFrame, predictions: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows by category and arm with ``score`` and the cross-fitted ``decision``, and their stored counts by arm and fold.

    Each arm must cover exactly the rows' folds. Windows meet the predictions of all arms in
    one join of arrays; that is stored, and the rows by category are only made as they are read.
    """
    spark = rows.sparkSession
    windows, path = spill(spark, _by_window(rows))
    told = predictions.where(F.col("arm").isin(*names)).select("arm", "fold", "chunk_id", "probabilities")
    wrong = F.col("probabilities").isNull() | (F.size("probabilities") != len(CATEGORIES)) | F.exists("probabilities", lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    times = [F.sum(F.when(F.col("arm") == name, 1).otherwise(0)).alias(f"_{i}") for i, name in enumerate(names)]  # a handful of arms
    given = told.groupBy("chunk_id", "fold").agg(F.max(wrong).alias("_wrong"), *times)
    both = windows.select("chunk_id", "fold", F.lit(True).alias("_here")).distinct().join(given, ["chunk_id", "fold"], "full")
    once = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{i}") == 1, F.lit(False)) for i in range(len(names))])
    require_empty(both.where(~once | F.col("_here").isNull() | F.col("_wrong")), "predictions do not cover exactly their folds")
    met, _ = spill(spark, windows.join(told, ["chunk_id", "fold"]))
    forget(spark, path)
    entries = met.select("arm", "contract", "chunk_id", "fold", "probabilities", F.explode("v").alias("e")).where("e.at >= 0")
    scored = entries.select("arm", "contract", "chunk_id", "fold", "e.category", "e.category_idx", "e.label", "e.mask", F.get("probabilities", F.col("e.at")).alias("score"))
    counts = metrics.stored_counts(scored, "arm", "fold")
    thresholds, _ = spill(spark, metrics.cross_fit_counted(counts, FINE_GRID, "arm"))
    decide = lambda frame: metrics.decided_by(frame, thresholds, "arm", "fold")
    return decide(scored), decide(counts)


def _mean(table: DataFrame, value: str, name: str, weak: tuple[str, ...] | None, *keys: str) -> DataFrame:
    """A figure of the macro row, or the mean of the weak categories."""
    if weak is None:
        return table.where("category = 'macro avg'").select(*keys, F.col(value).alias(name))
    own = table.where(F.col("category").isin(*weak)).groupBy(*keys)
    return own.agg((F.sum(metrics.fixed(F.col(value))) / (F.count(value) * F.lit(metrics.SCALE).cast("long"))).alias(name))


def compare(rows: DataFrame, runs: DataFrame, predictions: DataFrame, arms: tuple[str, ...], weak: tuple[str, ...] = WEAK_CATEGORIES) -> dict[str, DataFrame]:
    """``summarize`` without its ``pairs``: all figures come from one stored table of counts."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(a,) for a in arms], "arm string")
    folds, _ = spill(spark, complete_folds(runs, wanted))
    if folds.limit(2).count() < 2:
        raise ValueError("fewer than two folds are finished by every arm")
    kept = rows.join(F.broadcast(folds), "fold", "left_semi")  # a row per fold
    told = predictions.join(F.broadcast(folds), "fold", "left_semi")
    decided, counts = _decided(kept, told, list(arms))
    unknown = F.lit(None).cast("double")
    table = metrics.score_counted(counts, unknown, "arm")
    at_half = metrics.score_counted(metrics.decisions(counts.drop("decision"), 0.5), metrics.threshold_column(0.5), "arm")
    tuned = metrics.tune_counted(counts, TUNING_GRID, 0.5, "arm")
    in_sample = metrics.score_counted(metrics.decided_by(counts.drop("decision"), tuned, "arm"), unknown, "arm")
    per_category = table.join(at_half.select("arm", "category", F.col("f1").alias("f1_at_half")), ["arm", "category"]).join(in_sample.select("arm", "category", F.col("f1").alias("f1_tuned_in_sample")), ["arm", "category"])
    by_fold = metrics.score_counted(counts, unknown, "arm", "fold")
    per_fold = _mean(by_fold, "f1", "macro_f1", None, "arm", "fold").join(_mean(by_fold, "f1", "weak_f1", weak, "arm", "fold"), ["arm", "fold"]).join(_mean(by_fold, "average_precision", "macro_ap", None, "arm", "fold"), ["arm", "fold"])
    spread = per_fold.groupBy("arm").agg(F.stddev_samp("macro_f1").alias("macro_f1_fold_std"), F.stddev_samp("weak_f1").alias("weak_f1_fold_std"))
    costs = runs.join(F.broadcast(folds), "fold", "left_semi").groupBy("arm").agg(F.avg("loss").alias("loss_mean"), (F.avg("seconds") / 60).alias("minutes_mean"))
    macro = per_category.where("category = 'macro avg'").select("arm", F.col("f1").alias("macro_f1"), F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"), F.col("average_precision").alias("macro_ap"), "f1_at_half", "f1_tuned_in_sample")
    summary = macro.join(_mean(per_category, "f1", "weak_f1", weak, "arm"), "arm").join(spread, "arm").join(costs, "arm")
    return {"summary": summary, "per_category": per_category, "per_fold": per_fold, "ignored": ignored_runs(runs, folds), "folds": folds, "decided": decided}


def summarize(rows: DataFrame, runs: DataFrame, predictions: DataFrame, arms: tuple[str, ...], samples: int = 2000, weak: tuple[str, ...] = WEAK_CATEGORIES) -> dict[str, DataFrame]:
    """Arms compared on the folds that all of them finished: summary, per_category, per_fold, pairs, ignored.

    ``rows``: contract, chunk_id, category, category_idx, label, mask, fold; or a row per
    window with ``labels`` and ``label_mask`` in category order. Scores are out-of-fold,
    decisions cross-fitted; ``f1_tuned_in_sample`` is tuned on the rows that it is
    scored on, too kind, and never chosen by. Fails with fewer than two such folds.
    """
    found = compare(rows, runs, predictions, arms, weak)
    return found | {"pairs": bootstrap.paired_bootstrap(found["decided"], samples, weak=weak)}


def select(rows: DataFrame, runs: DataFrame, predictions: DataFrame, samples: int = 2000) -> dict[str, DataFrame]:
    """The configuration to fit finally, from those that finished every fold: summary, pairs, decision, thresholds, incomplete.

    An arm here is a configuration's name (``bootstrap.config_name``), from which rate and
    epochs are read. The thresholds are those of the picked configuration's out-of-fold scores.
    """
    spark = rows.sparkSession
    ready, _ = spill(spark, complete_arms(runs, rows.select("fold").distinct()))
    names = sorted(r["arm"] for r in ready.collect())  # a handful of configurations
    if not names:
        raise ValueError("no configuration has finished every fold")
    decided, counts = _decided(rows, predictions, names)
    table = metrics.score_counted(counts, F.lit(None).cast("double"), "arm")
    parsed = bootstrap.parsed_config(F.col("arm"))
    summary = _mean(table, "f1", "macro_f1", None, "arm").select(F.col("arm").alias("config"), "macro_f1", parsed["epochs"].alias("epochs"), parsed["learning_rate"].alias("learning_rate"))
    pairs, _ = spill(spark, bootstrap.paired_bootstrap(decided, samples))
    decision, _ = spill(spark, bootstrap.select_config(summary, pairs))
    pick = decision.first()["pick"]
    thresholds = metrics.final_thresholds(decided.where(F.col("arm") == pick).drop("decision", "arm"))
    incomplete = runs.select("arm").distinct().join(F.broadcast(ready), "arm", "left_anti")  # a row per configuration
    return {"summary": summary, "pairs": pairs, "decision": decision, "thresholds": thresholds, "incomplete": incomplete}
