"""Labels of windows from annotated spans: an interval join, then one flag per window and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators.checks import require_columns, require_empty
from lexspan.schema import CATEGORIES


def evidence(windows: DataFrame, spans: DataFrame, categories: tuple[str, ...] = CATEGORIES, bin_chars: int | None = None) -> DataFrame:
    """Every (window, span) pair of one contract that overlaps; intervals that only touch do not.

    The equi-join on the contract keeps the bounds as join conditions, so no product is
    made. For contracts with very many windows and spans ``bin_chars`` also joins on
    stretches of so many characters, which splits a contract over tasks; a pair is then
    taken from the stretch where its overlap starts.
    """
    require_columns(windows, "contract", "chunk_id", "start", "end")
    require_columns(spans, "contract", "category", "start", "end")
    left = windows.select("contract", "chunk_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    right = spans.where(F.col("category").isin(*categories)).select("contract", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end")).distinct()
    on = (F.col("ws") < F.col("span_end")) & (F.col("span_start") < F.col("we"))
    if bin_chars is None:
        pairs = left.join(right.withColumnRenamed("contract", "_c"), (F.col("contract") == F.col("_c")) & on).drop("_c")
    else:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_chars), F.floor((F.col(b) - 1) / bin_chars)))
        left = left.where("ws < we").withColumn("_bin", bins("ws", "we"))
        right = right.where("span_start < span_end").withColumn("_b", bins("span_start", "span_end")).withColumnRenamed("contract", "_c")
        first = F.floor(F.greatest("ws", "span_start") / bin_chars) == F.col("_bin")
        pairs = left.join(right, (F.col("contract") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & on & first).drop("_c", "_b", "_bin")
    return pairs.select(
        "chunk_id", "contract", "category", "span_start", "span_end", F.greatest("ws", "span_start").alias("overlap_start"), F.least("we", "span_end").alias("overlap_end"),
        ((F.col("ws") <= F.col("span_start")) & (F.col("span_end") <= F.col("we"))).alias("fully_contained"),
    )


def label_arrays(windows: DataFrame, found: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The windows, a row each, with ``labels`` and ``label_mask`` in category order.

    A window that holds a whole span of a category is positive; one that only cuts spans
    of it is masked (mask false: unknown); all others are negative. Windows meet their
    evidence before there is a row for each category, so only windows are shuffled.
    """
    full = [F.bool_or(F.when(F.col("category") == c, F.col("fully_contained"))).alias(f"_{i}") for i, c in enumerate(categories)]
    touched = found.groupBy("chunk_id").agg(*full).select("chunk_id", F.array(*(f"_{i}" for i in range(len(full)))).alias("_full"))
    flags = F.coalesce("_full", F.array_repeat(F.lit(None).cast("boolean"), len(full)))
    joined = windows.join(touched, "chunk_id", "left").select(*windows.columns, flags.alias("_full"))
    labels = F.transform("_full", lambda f: F.coalesce(f, F.lit(False)).cast("int"))
    return joined.select(*windows.columns, labels.alias("labels"), F.transform("_full", lambda f: F.coalesce(f, F.lit(True))).alias("label_mask"))


def labels_of(windows: DataFrame, found: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """window x category with ``label`` and ``mask`` as ``label_arrays`` has them, all other columns of the windows kept."""
    told = from_arrays(label_arrays(windows, found, categories), categories)
    return told.select(*windows.columns, "category", "category_idx", "label", "mask")


def label_windows(windows: DataFrame, spans: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    return labels_of(windows, evidence(windows, spans, categories), categories)


def as_arrays(labeled: DataFrame) -> DataFrame:
    """Long labels as one row per window with ``labels`` and ``label_mask`` in category order."""
    rows = labeled.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("category_idx", "label", "mask"))).alias("v"))
    return rows.select("chunk_id", F.transform("v", lambda x: x["label"]).alias("labels"), F.transform("v", lambda x: x["mask"]).alias("label_mask"))


def from_arrays(labeled: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    names = F.array(*(F.lit(c) for c in categories))
    rows = labeled.select("*", F.posexplode(F.arrays_zip("labels", "label_mask")).alias("category_idx", "v"))
    kept = [c for c in labeled.columns if c not in ("labels", "label_mask")]
    return rows.select(*kept, F.element_at(names, F.col("category_idx") + 1).alias("category"), "category_idx", F.col("v.labels").alias("label"), F.col("v.label_mask").alias("mask"))


def contained_spans(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans that some window of their contract holds as a whole."""
    return _by_containment(windows, spans, "left_semi")


def uncovered_spans(windows: DataFrame, spans: DataFrame) -> DataFrame:
    return _by_containment(windows, spans, "left_anti")


def _by_containment(windows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    bounds = windows.select(F.col("contract").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(bounds, (F.col("contract") == F.col("_c")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), how)


def report(labeled: DataFrame, found: DataFrame, windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Figures of a labelling, one row each (``name``, ``value``)."""
    touched = found.groupBy("chunk_id").agg(F.max(F.col("fully_contained").cast("int")).alias("full"))
    by_window = labeled.groupBy("chunk_id").agg(F.sum("label").alias("n"))
    distinct = spans.select("contract", "category", "start", "end").distinct()
    one = lambda name, frame: frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
    parts = [
        one("chunks", windows), one("spans", spans), one("duplicate_spans", spans.select("contract", "category", "start", "end").exceptAll(distinct)),
        one("contained_spans", contained_spans(windows, distinct)), one("uncovered_spans", uncovered_spans(windows, distinct)),
        one("no_overlap", windows.join(touched, "chunk_id", "left_anti")), one("partial_only", touched.where("full = 0")), one("multi_label", by_window.where("n > 1")),
        one("positive_pairs", labeled.where("label = 1")), one("masked_pairs", labeled.where("not mask")), one("evidence", found),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_labels(windows: DataFrame, spans: DataFrame, labeled: DataFrame) -> None:
    """Derive all labels again, by existence instead of aggregation, and fail on any difference."""
    columns = ["chunk_id", "category", "label", "mask"]
    s = spans.select(F.col("contract").alias("_c"), F.col("category").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    grid = labeled.select("chunk_id", "category").join(windows.select("chunk_id", "contract", "start", "end"), "chunk_id")
    same = (F.col("contract") == F.col("_c")) & (F.col("category") == F.col("_k"))
    full = grid.join(s, same & (F.col("start") <= F.col("_s")) & (F.col("_e") <= F.col("end")), "left_semi").select("chunk_id", "category", F.lit(1).alias("label"), F.lit(True).alias("mask"))
    cut = grid.join(s, same & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_semi").join(full, ["chunk_id", "category"], "left_anti").select("chunk_id", "category", F.lit(0).alias("label"), F.lit(False).alias("mask"))
    rest = grid.join(full.unionByName(cut), ["chunk_id", "category"], "left_anti").select("chunk_id", "category", F.lit(0).alias("label"), F.lit(True).alias("mask"))
    again = full.unionByName(cut).unionByName(rest).select(*columns)
    given = labeled.select(*columns)
    require_empty(given.exceptAll(again), "labels differ from their spans")
    require_empty(again.exceptAll(given), "labels are missing")
