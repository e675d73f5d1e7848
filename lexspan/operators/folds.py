"""Folds, subsets and samples of whole contracts."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.checks import require_empty


def fold_plan(sizes: dict[int, int], k: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each contract size, the folds of its first contracts and the cycle that the rest follow.

    ``sizes``: how many contracts have each size. Largest first, each contract goes to the
    lightest fold (the lowest of equals). Once all loads lie within one size of each other
    the lightest becomes the heaviest with every step, so the folds come round in turn; a
    size's contracts therefore need only a short list and a cycle, however many there are.
    """
    loads = [(0, f) for f in range(k)]
    plan: dict[int, tuple[list[int], list[int]]] = {}
    for size in sorted(sizes, reverse=True):
        left, first = sizes[size], []
        heapq.heapify(loads)
        while left and (max(loads)[0] - loads[0][0] >= size):
            load, fold = loads[0]
            heapq.heapreplace(loads, (load + size, fold))
            first.append(fold)
            left -= 1
        order = sorted(loads)
        cycle = [f for _, f in order]
        turns, odd = divmod(left, k)
        loads = [(load + size * (turns + (i < odd)), f) for i, (load, f) in enumerate(order)]
        plan[size] = first, cycle
    return plan


#: Rows of one size that one task ranks.
SLICE = 1_000_000


def ranked_within(rows: DataFrame, group: str, order: str, sizes: dict[int, int]) -> DataFrame:
    """Adds ``r``, each row's place (from 0) in its group by ``order``; a group of more than ``SLICE`` rows is ranked in slices of its order."""
    if max(sizes.values()) <= SLICE:
        return rows.withColumn("r", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))
    share = min(1.0, 200_000 / sum(sizes.values()))  # bounds that part each large group; any bounds are right
    large = [g for g, n in sizes.items() if n > SLICE]
    cuts = rows.where(F.col(group).isin(large)).sample(share, 7).groupBy(group).agg(F.array_sort(F.collect_set(order)).alias("names")).collect()
    bounds = []
    for r in cuts:
        parts = max(1, -(-2 * sizes[r[group]] // SLICE))
        step = max(1, len(r["names"]) // parts)
        bounds.append((r[group], r["names"][step::step]))
    told = rows.sparkSession.createDataFrame(bounds, f"{group} {rows.schema[group].dataType.simpleString()}, _bounds array<string>")
    dealt = rows.join(F.broadcast(told), group, "left").withColumn("_slice", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col(order))), F.lit(0))).drop("_bounds")  # a row per large group
    before = dealt.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = before.select(group, "_slice", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order)) - 1
    return dealt.withColumn("r", within).join(F.broadcast(before), [group, "_slice"]).withColumn("r", (F.col("r") + F.col("_before")).cast("long")).drop("_slice", "_before")  # a row per slice


def contract_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """contract, fold, chunks: every contract in one fold, largest first to the lightest fold, ties by name.

    Only the number of contracts of each size comes to the driver. The same rows in any
    order give the same folds.
    """
    counts = rows.groupBy("contract").agg(F.count("*").alias("chunks"))
    sizes = {r["chunks"]: r["n"] for r in counts.groupBy("chunks").agg(F.count("*").alias("n")).collect()}
    if not 2 <= k <= sum(sizes.values()):
        raise ValueError(f"{k} folds of {sum(sizes.values())} contracts")
    plan = fold_plan(sizes, k)
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, a, c) for s, (a, c) in plan.items()], "chunks long, first array<int>, cycle array<int>")
    ranked = ranked_within(counts, "chunks", "contract", sizes).join(F.broadcast(table), "chunks")  # a row per size
    fold = F.when(F.col("r") < F.size("first"), F.get("first", F.col("r").cast("int"))).otherwise(F.get("cycle", ((F.col("r") - F.size("first")) % k).cast("int")))
    return ranked.select("contract", fold.cast("int").alias("fold"), "chunks")


def with_fold(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Adds each row's fold; fails if a contract has none, or several. The checks look at contracts, not at rows."""
    one = folds.groupBy("contract").agg(F.min("fold").alias("fold"), F.max("fold").alias("_f"))
    require_empty(one.where("fold <> _f"), "a contract in two folds")
    one = one.where("fold is not null").drop("_f")
    require_empty(rows.select("contract").distinct().join(one, "contract", "left_anti"), "no fold for a contract")
    return rows.join(one, "contract")


def split_by_fold(rows: DataFrame, folds: DataFrame, validation: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of the split ``train``; fails if either is empty."""
    require_empty(rows.where("split <> 'train'").select("contract", "split"), "only training rows have folds")
    placed = with_fold(rows, folds)
    sides = folds.join(rows.select("contract").distinct(), "contract", "left_semi").agg(F.bool_or(F.col("fold") != validation), F.bool_or(F.col("fold") == validation)).first()
    if not (sides[0] and sides[1]):
        raise ValueError(f"fold {validation} leaves one side empty")
    return placed.where(F.col("fold") != validation).drop("fold"), placed.where(F.col("fold") == validation).drop("fold")


def draw(seed: int, *parts: Column) -> Column:
    """A 32-bit number from a seed and columns, the same on any engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def select_contracts(rows: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """All rows of ``count`` contracts, drawn by hash, whatever the order of rows."""
    total = rows.select("contract").distinct()
    if count < 1:
        raise ValueError("at least one contract is needed")
    chosen = total.orderBy(draw(seed, F.col("contract")), "contract").limit(count)
    return rows.join(chosen, "contract", "left_semi")


def downsample(rows: DataFrame, rate: float = 2.0, seed: int = 42, epoch: int = 0) -> DataFrame:
    """All windows with a positive label and, drawn anew each epoch, ``rate`` times as many others.

    ``rows``: one per window, with ``positive``. The quota is met exactly (or all taken):
    the draws are cut at the quota's order statistic, found from counts of the draws'
    leading bits, so the rows are not sorted in one place.
    """
    drawn = rows.withColumn("_d", F.when(F.col("positive"), F.lit(-1).cast("long")).otherwise(draw(seed * 1000 + epoch, F.col("chunk_id"))))
    counts = drawn.agg(F.sum(F.col("positive").cast("long")).alias("p")).first()["p"] or 0
    quota = round(rate * counts)  # halves to the even number
    negatives = drawn.where("not positive")
    cells = negatives.groupBy((F.col("_d") / 2**20).cast("int").alias("cell")).agg(F.count("*").alias("n"))  # 4096 cells at most
    seen = 0
    cut, inside = None, 0
    for r in sorted(cells.collect()):
        if seen + r["n"] > quota:
            cut, inside = r["cell"], quota - seen
            break
        seen += r["n"]
    positive = drawn.where("positive")
    if cut is None:
        return positive.unionByName(negatives).drop("_d")
    cell = (F.col("_d") / 2**20).cast("int")
    edge = negatives.where(cell == cut).orderBy("_d", "chunk_id").limit(inside)
    return positive.unionByName(negatives.where(cell < cut)).unionByName(edge).drop("_d")


def fits_all(rows: DataFrame, lengths: list[str], limit: int) -> DataFrame:
    """Rows whose token counts are within the limit for every tokenizer (columns ``lengths``)."""
    return rows.where(F.greatest(*lengths, F.lit(0)) <= limit)
