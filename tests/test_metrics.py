import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import bootstrap, folds, metrics
from lexspan.plans import samples
from lexspan.schema import CATEGORIES

LONG = "contract string, chunk_id string, category string, category_idx int, label int, mask boolean, score double, fold int"
GL, AR = "Governing Law", "Audit Rights"


def long(spark, *rows):
    """(category, label, mask, score[, fold])"""
    return spark.createDataFrame([(f"c{i}", f"w{i}", r[0], CATEGORIES.index(r[0]), r[1], r[2], float(r[3]), r[4] if len(r) > 4 else 0) for i, r in enumerate(rows)], LONG)


def by_category(frame):
    return {r["category"]: r for r in frame.collect()}


def test_masked_rows_do_not_count(spark):
    got = by_category(metrics.score(long(spark, (GL, 1, True, 0.9), (GL, 0, True, 0.1), (GL, 0, False, 0.9), (AR, 1, True, 0.9), (AR, 0, True, 0.1), (AR, 0, True, 0.2))))
    assert (got[GL]["precision"], got[GL]["recall"], got[GL]["f1"], got[GL]["scored_chunks"], got[GL]["masked_chunks"]) == (1, 1, 1, 2, 1)
    assert got["macro avg"]["f1"] == 1 and got["micro avg"]["f1"] == 1 and got["micro avg"]["average_precision"] is None
    assert got["macro avg"]["threshold"] == 0.5


def test_nothing_scored_is_null(spark):
    got = by_category(metrics.score(long(spark, (GL, 1, False, 0.9), (AR, 1, True, 0.9)), {**dict.fromkeys(CATEGORIES, 0.5), GL: 0.3}))
    assert got[GL]["f1"] is None and got[GL]["scored_chunks"] == 0 and got["macro avg"]["f1"] == 1 and got["macro avg"]["threshold"] is None


def test_equal_score_is_positive_and_trade_off(spark):
    rows = long(spark, (GL, 1, True, 0.9), (GL, 1, True, 0.4), (GL, 0, True, 0.6))
    low, high = (by_category(metrics.score(rows, t))[GL] for t in (0.3, 0.8))
    assert low["recall"] == 1 and low["precision"] == 2 / 3 and high["recall"] == 0.5 and high["precision"] == 1
    assert by_category(metrics.score(long(spark, (GL, 1, True, 0.5))))[GL]["recall"] == 1


def test_average_precision_and_curve_against_brute_force(spark):
    rng = random.Random(1)
    data = [(GL, int(rng.random() < 0.3), True, rng.randint(0, 40) / 40) for _ in range(300)]
    rows = long(spark, *data)
    total = sum(y for _, y, _, _ in data)
    ap, last, points = 0.0, 0.0, {(0.0, 1.0)}
    for t in sorted({s for *_, s in data}, reverse=True):
        tp = sum(y for _, y, _, s in data if s >= t)
        n = sum(s >= t for *_, s in data)
        ap += (tp / total - last) * tp / n
        last = tp / total
        points.add((tp / total, tp / n))
    assert math.isclose(metrics.average_precision(rows).first()["average_precision"], ap, abs_tol=1e-9)
    assert {(r["recall"], r["precision"]) for r in metrics.pr_curve(rows).collect()} == points


@pytest.mark.parametrize(
    ("rows", "grid", "threshold", "f1", "gain"),
    [
        ([(1, True, 0.6), (1, True, 0.6), (0, True, 0.4), (0, True, 0.4)], (0.3, 0.5, 0.7), 0.5, 1.0, 0.0),
        ([(1, True, 0.3), (1, True, 0.25), (0, True, 0.05), (0, True, 0.05)], (0.1, 0.5, 0.9), 0.1, 1.0, 1.0),
        ([(1, True, 0.5), (0, True, 0.1)], (0.2, 0.3), 0.2, 1.0, 0.0),
        ([(0, True, 0.5), (0, True, 0.1)], (0.2, 0.3), 0.5, None, None),
        ([(1, True, 0.6), (0, False, 0.8), (0, True, 0.4)], (0.3, 0.5, 0.7), 0.5, 1.0, 0.0),
    ],
)
def test_tuning(spark, rows, grid, threshold, f1, gain):
    got = metrics.tune_thresholds(long(spark, *((GL, *r) for r in rows)), grid).first()
    assert (got["threshold"], got["f1"], got["f1_gain"]) == (threshold, f1, gain)


def test_tuning_grid_must_rise(spark):
    with pytest.raises(ValueError):
        metrics.tune_thresholds(long(spark, (GL, 1, True, 0.5)), (0.3, 0.3))


def test_cross_fit(spark):
    rows = long(spark, (GL, 1, True, 0.9, 0), (GL, 0, True, 0.7, 0), (GL, 1, True, 0.3, 1), (GL, 0, True, 0.1, 1))
    got = {r["fold"]: r["threshold"] for r in metrics.cross_fit_thresholds(rows).collect()}
    assert got == {0: 0.11, 1: 0.71}
    assert [r["decision"] for r in metrics.cross_fit_decisions(rows).orderBy("chunk_id").collect()] == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        metrics.cross_fit_decisions(rows.where("fold = 0"))


def test_positive_weights(spark):
    assert metrics.positive_weights(long(spark, (GL, 1, True, 0), (GL, 0, True, 0), (GL, 0, True, 0), (GL, 0, False, 0))).first()["weight"] == 2
    with pytest.raises(ValueError):
        metrics.positive_weights(long(spark, (GL, 0, True, 0)))


def test_losses(spark):
    schema = "category string, label int, mask boolean, logit double"
    rows = spark.createDataFrame([(GL, 1, True, 0.0), (GL, 1, True, math.log(3)), (GL, 1, False, 50.0), (GL, 0, False, float("nan"))], schema)
    assert math.isclose(metrics.masked_bce(rows).first()[0], (math.log(2) - math.log(0.75)) / 2)
    assert metrics.masked_bce(rows.where("not mask")).first()[0] == 0
    wrong = spark.createDataFrame([(GL, 0, True, 1000.0), (GL, 1, True, -1000.0)], schema)
    assert metrics.masked_bce(wrong).first()[0] == 1000
    two = spark.createDataFrame([(GL, 1, True, 0.0), (GL, 0, True, 0.0)], schema)
    assert math.isclose(metrics.masked_bce(two, {GL: 3.0}).first()[0], 2 * math.log(2))
    assert math.isclose(metrics.masked_focal(two).first()[0], 0.25 * math.log(2) / 2)
    batches = spark.createDataFrame([(2.0, 10), (4.0, 1)], "loss double, valid int")
    assert math.isclose(metrics.weighted_mean_loss(batches).first()[0], 24 / 11)


def test_pooling_checks_scores(spark):
    rows = long(spark, (GL, 1, True, 0.2), (GL, 0, True, 0.7)).withColumn("contract", F.lit("c"))
    assert tuple(metrics.pool_contracts(rows).select("score", "label").first()) == (0.7, 1)
    with pytest.raises(ValueError):
        metrics.pool_contracts(rows.withColumn("score", F.lit(1.5)))


def greedy(counts, k):
    loads, out = [0] * k, {}
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        loads[f] += n
        out[name] = f
    return out


@pytest.mark.parametrize("seed", range(6))
def test_folds_are_greedy_by_size(spark, seed):
    rng = random.Random(seed)
    counts = {f"c{i:03d}": rng.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(rng.randint(5, 90))}
    plan = folds.fold_plan({s: list(counts.values()).count(s) for s in set(counts.values())}, 4)
    got = {}
    for size, (first, cycle) in plan.items():
        for r, name in enumerate(sorted(c for c, n in counts.items() if n == size)):
            got[name] = first[r] if r < len(first) else cycle[(r - len(first)) % 4]
    assert got == greedy(counts, 4)


def test_contract_folds(spark):
    counts = {"a": 2, "b": 1, "c": 3, "d": 1, "e": 1, "f": 1}
    rows = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "contract string")
    table = folds.contract_folds(rows, 3)
    assert {r["contract"]: r["fold"] for r in table.collect()} == greedy(counts, 3)
    for k in (1, 7):
        with pytest.raises(ValueError):
            folds.contract_folds(rows, k)
    train, held = folds.split_by_fold(rows.withColumn("split", F.lit("train")), table, 0)
    assert train.count() + held.count() == 9
    with pytest.raises(ValueError):
        folds.with_fold(rows, table.where("contract <> 'a'"))


def test_downsampling_quota(spark):
    rows = spark.createDataFrame([(f"w{i}", i < 15) for i in range(100)], "chunk_id string, positive boolean")
    first = {r[0] for r in folds.downsample(rows, 2.0, 42, 0).select("chunk_id").collect()}
    again = {r[0] for r in folds.downsample(rows.repartition(7), 2.0, 42, 0).select("chunk_id").collect()}
    other = {r[0] for r in folds.downsample(rows, 2.0, 42, 1).select("chunk_id").collect()}
    assert len(first) == 45 and first == again and other != first and len(folds.downsample(rows, 20.0).collect()) == 100


def test_bootstrap(spark):
    rows = []
    for i in range(10):
        for arm in ("full", "half", "twin"):
            rows.append((arm, f"c{i}", "Exclusivity", 1, True, 1 if arm != "half" or i < 5 else 0))
            rows.append((arm, f"c{i}", GL, 1, True, 1))
    decided = spark.createDataFrame(rows, "arm string, contract string, category string, label int, mask boolean, decision int")
    got = {(r["arm_a"], r["arm_b"], r["metric"]): r for r in bootstrap.paired_bootstrap(decided, 40).collect()}
    assert math.isclose(got["full", "half", "macro_f1"]["difference"], 1 - (10 / 15 + 1) / 2, abs_tol=1e-9)
    same = got["full", "twin", "macro_f1"]
    assert (same["difference"], same["ci_low"], same["ci_high"]) == (0, 0, 0)
    sums = {(r["arm"], r["category"], r["sample"]): (r["tp"], r["fp"], r["fn"]) for r in bootstrap.resampled_sums(bootstrap.contract_counts(decided), 7).collect()}
    assert len(sums) == 3 * 2 * 8 and sums["half", "Exclusivity", -1] == (5, 0, 5)
    for sample in range(7):
        weight = [sum(int.from_bytes(hashlib.md5(f"42:c{i}:{sample // 4}".encode()).digest()[4 * (sample % 4) :][:4], "big") >= b for b in bootstrap.weight_bounds()) for i in range(10)]
        assert sums["half", "Exclusivity", sample] == (sum(weight[:5]), 0, sum(weight[5:]))
        assert sums["full", GL, sample] == (sum(weight), 0, 0)


def test_weights_are_poisson():
    bounds = bootstrap.weight_bounds()
    share = [b / 2**32 for b in bounds]
    assert math.isclose(share[0], math.exp(-1), rel_tol=1e-6) and math.isclose(sum(1 - s for s in share), 1, abs_tol=1e-6)


def test_bootstrap_queries_draw_2000_samples(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from lexspan.plans import catalog

    docs = [(i, " ".join(f"w{i}x{k}" for k in range(150 + 20 * (i % 5))), "en") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("boot_paired", "boot_contract"):
        key = lambda r: tuple(x for x in r if isinstance(x, str))
        got, want = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=key), sorted(duckdb.execute(catalog.SQL[name]).fetchall(), key=key)
        assert len(got) == len(want) > 0
        for a, b in zip(got, want):
            assert a == pytest.approx(b, abs=1e-8)


def test_decisions(spark):
    summary, pairs = samples.arm_tables(spark)
    found = bootstrap.choose_arm(summary, pairs).first().asDict()
    assert found == {"pick": "focal", "decided_by": "weak_f1", "macro_f1_leader": "pos_weight", "macro_f1_level": ["pos_weight", "focal"], "weak_f1_leader": "focal", "weak_f1_level": ["focal"], "macro_f1_against_control": 1, "weak_f1_against_control": 1}
    macro = (F.col("arm_a") == "focal") & (F.col("metric") == "macro_f1")
    clear = pairs.withColumn("ci_low", F.when(macro, F.lit(-0.5)).otherwise(F.col("ci_low"))).withColumn("ci_high", F.when(macro, F.lit(-0.1)).otherwise(F.col("ci_high")))
    assert bootstrap.choose_arm(summary, clear).first()["decided_by"] == "macro_f1"
    tied = pairs.withColumn("ci_low", F.lit(-0.1)).withColumn("ci_high", F.lit(0.1))
    found = bootstrap.choose_arm(summary, tied).first()
    assert (found["pick"], found["decided_by"], found["macro_f1_against_control"]) == ("pos_weight", "simplicity", 0)
    worse = pairs.withColumn("ci_low", F.lit(0.1)).withColumn("ci_high", F.lit(0.2))  # the first of each pair is better, and the control is first
    assert bootstrap.choose_arm(summary, worse).first()["weak_f1_against_control"] == -1
    with pytest.raises(ValueError):
        bootstrap.choose_arm(summary, pairs.unionByName(pairs)).first()
    with pytest.raises(ValueError):
        bootstrap.choose_arm(summary, pairs.where("metric = 'macro_f1'")).first()
    assert bootstrap.select_config(*samples.config_tables(spark)).first()["pick"] == "lr2e-05-ep2"


def test_thresholds_of_unknown_categories_are_refused():
    from lexspan.operators.checks import threshold_values

    with pytest.raises(ValueError):
        threshold_values(dict.fromkeys(CATEGORIES, 0.5) | {"No Such": 0.5})


@pytest.mark.parametrize("rate, positives, others", [(0.5, 1, 0), (2.5, 1, 2), (0.5, 3, 2)])
def test_half_quotas_go_to_the_even_number(spark, rate, positives, others):
    rows = spark.createDataFrame([(f"w{i}", i < positives) for i in range(20)], "chunk_id string, positive boolean")
    assert folds.downsample(rows, rate).count() == positives + others


def test_ranks_in_slices_of_one_large_group(spark, monkeypatch):
    from lexspan.operators import folds

    monkeypatch.setattr(folds, "SLICE", 10)
    rows = spark.createDataFrame([(f"c{i:03}", 5 if i % 7 else i % 3) for i in range(200)], "contract string, size long")
    sizes = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    told = folds.ranked_within(rows, "size", "contract", sizes).collect()
    for size in sizes:
        own = sorted((r["contract"], r["r"]) for r in told if r["size"] == size)
        assert [p for _, p in own] == list(range(sizes[size]))
