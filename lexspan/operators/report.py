"""The evaluation report over configurations and levels, and the analysis of errors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators import metrics
from lexspan.operators.checks import require_empty, threshold_values
from lexspan.schema import CATEGORIES


def _chosen(configurations: Mapping[str, object], categories: Iterable[str]) -> Column:
    """configuration and threshold of every configuration, for the row's category."""
    told = [(name, threshold_values(t, categories)) for name, t in configurations.items()]
    at = lambda values: F.element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), F.col("category"))
    return F.array(*(F.struct(F.lit(name).alias("configuration"), at(values).alias("threshold")) for name, values in told))


def evaluation_report(chunks: DataFrame, contracts: DataFrame, configurations: Mapping[str, object], train: DataFrame | None = None, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """Scores of every configuration on both levels (``chunk``, ``contract``), a row per category, and macro and micro rows.

    ``chunks``: contract, chunk_id, category, category_idx, label, mask, score. ``contracts``:
    contract, category, label, the truth; a contract's score is the highest of its windows.
    ``configurations`` names thresholds (one, or one per category); all are scored from one
    reading of the rows. Fails if contracts were trained on (``train``), if the windows do not
    cover exactly the contracts, or on scores that are no probability. ``no_support`` and
    ``nothing_predicted`` mark figures that rest on nothing.
    """
    if train is not None:
        require_empty(train.select("contract").intersect(contracts.select("contract")), "contracts were trained on")
    metrics.require_same_contracts(chunks, contracts)
    pooled = metrics.pool_contracts(chunks).drop("label").join(contracts.select("contract", "category", "label"), ["contract", "category"])
    columns = ("level", "contract", "category", "label", "mask", "score")
    both = chunks.withColumn("level", F.lit("chunk")).select(*columns).unionByName(pooled.withColumn("level", F.lit("contract")).select(*columns))
    counts = metrics.stored_counts(both, "level")  # every figure comes from these
    rows = counts.withColumn("c", F.explode(_chosen(configurations, categories))).select(*counts.columns, "c.configuration", "c.threshold")
    when = lambda c, n="n": F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    valid, hit = F.col("mask"), F.col("score") >= F.col("threshold")
    sums = [when(valid, "tp").alias("support"), when(valid).alias("scored"), when(~valid).alias("masked"), when(valid & hit).alias("predicted_positive"), when(valid & hit, "tp").alias("tp")]
    keys = ["level", "configuration"]
    both_levels = rows.groupingSets([[F.col(k) for k in (*keys, "category")], [F.col(k) for k in keys]], *keys, "category").agg(*sums, F.when(F.min("threshold") == F.max("threshold"), F.min("threshold")).alias("threshold"))
    some = F.col("scored") > 0
    rate = lambda a, b: F.when(some, metrics.ratio(a, b))
    t, p, s = F.col("tp"), F.col("predicted_positive"), F.col("support")
    rated = both_levels.select(*keys, F.coalesce("category", F.lit("micro avg")).alias("category"), "threshold", "support", "scored", "masked", "predicted_positive", rate(t, p).alias("precision"), rate(t, s).alias("recall"), rate(2 * t, p + s).alias("f1"))
    rated = rated.join(metrics.precision_counted(counts, "level"), ["level", "category"], "left")
    mean = lambda c: (F.sum(metrics.fixed(F.col(c))) / (F.count(c) * F.lit(metrics.SCALE).cast("long"))).alias(c)
    macro = rated.where("category <> 'micro avg'").groupBy(*keys).agg(F.lit("macro avg").alias("category"), F.when(F.min("threshold") == F.max("threshold"), F.min("threshold")).alias("threshold"), *(F.sum(c).alias(c) for c in ("support", "scored", "masked", "predicted_positive")), *(mean(c) for c in ("precision", "recall", "f1", "average_precision")))
    return rated.unionByName(macro).withColumn("no_support", F.col("support") == 0).withColumn("nothing_predicted", F.col("predicted_positive") == 0)


def nearest_evidence(errors: DataFrame, spans: DataFrame) -> DataFrame:
    """``errors`` (contract, start, end, ...) with ``distance``, the characters to the nearest span of any category (0: they overlap; null: the contract has none).

    Spans and windows of a contract are put in one order of their starts; the nearest span
    before is the one that reaches furthest, the nearest after the next to start.
    """
    keyed = errors.select(F.struct("*").alias("row"), "contract", "start", "end")
    marks = keyed.select("contract", "start", "end", "row", F.lit(None).cast("long").alias("reach"), F.lit(None).cast("long").alias("begin"))
    own = spans.select("contract", "start", "end", F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), F.col("end").alias("reach"), F.col("start").alias("begin"))
    order = Window.partitionBy("contract").orderBy("start")
    both = marks.unionByName(own).withColumn("reached", F.max("reach").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.min("begin").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    past = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(0)))
    gap = F.least(past(F.col("start"), F.col("reached")), past(F.col("next"), F.col("end")))  # null where there is no span on a side
    return both.where("row is not null").select("row.*", gap.alias("distance"))


def error_analysis(decided: DataFrame, evidence: DataFrame, spans: DataFrame, near: int = 200) -> dict[str, DataFrame]:
    """What stands where a detector errs: ``errors`` (kind, category, errors, nothing_near, and its share) and ``company``.

    ``decided``: contract, chunk_id, start, end, category, label, mask, decision. Errors are
    unmasked windows decided wrongly (``false positive``, ``false negative``). Nothing is near
    if no span of any category is within ``near`` characters. ``company``: kind, category,
    other, n: in how many of the errors evidence (chunk_id, category) of another category is
    in the same window.
    """
    kind = F.when(F.col("decision") == 1, "false positive").otherwise("false negative")
    wrong = decided.where(F.col("mask") & (F.col("label") != F.col("decision"))).select("contract", "chunk_id", "start", "end", "category", kind.alias("kind"))
    far = F.coalesce(F.col("distance") > near, F.lit(True))
    counted = nearest_evidence(wrong, spans).groupBy("kind", "category").agg(F.count("*").alias("errors"), F.sum(far.cast("long")).alias("nothing_near"))
    others = evidence.select("chunk_id", F.col("category").alias("other")).distinct()
    company = wrong.select("chunk_id", "category", "kind").join(others, "chunk_id").where("other <> category").groupBy("kind", "category", "other").agg(F.count("*").alias("n"))
    return {"errors": counted.withColumn("share_nothing_near", F.col("nothing_near") / F.col("errors")), "company": company}
