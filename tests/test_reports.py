"""Score matrices, run ledgers, manifests, the test lock, encoded rows and reports."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from lexspan.operators import bootstrap, encoding, ledger, manifest, matrices, report
from lexspan.sources import annotations

AB = ("A", "B")


def matrix_of(spark, rows):
    return spark.createDataFrame(rows, "row long, scores array<double>, chunk_id string")


def test_matrices_that_fit_and_that_do_not(spark):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "row long, chunk_id string")
    good = [(i, [i / 4, 1.0], f"c{i}") for i in range(4)]
    found = matrices.aligned(rows, matrix_of(spark, good), AB)
    assert sorted((r["chunk_id"], r["category"], r["score"]) for r in found.collect()) == sorted((c, k, s) for _, v, c in good for k, s in zip(AB, v))
    wrong = {
        "moved": [(0, [0.0, 0.0], "c1"), (1, [0.0, 0.0], "c0"), *good[2:]], "missing": good[:3], "surplus": [*good, (4, [0.0, 0.0], "c4")],
        "repeated": [*good, good[0]], "width": [*good[:3], (3, [0.5], "c3")], "value": [*good[:3], (3, [0.5, float("nan")], "c3")],
    }
    for check, matrix in wrong.items():
        told = {r["check"] for r in matrices.matrix_violations(rows, matrix_of(spark, matrix), AB).collect()}
        assert told == {check}
        with pytest.raises(ValueError):
            matrices.aligned(rows, matrix_of(spark, matrix), AB)
    for value in (None, -0.1, 1.1, float("inf")):
        assert {r["check"] for r in matrices.matrix_violations(rows, matrix_of(spark, [*good[:3], (3, [0.5, value], "c3")]), AB).collect()} == {"value"}
    assert {r["check"] for r in matrices.matrix_violations(rows, matrix_of(spark, [*good[:3], (None, [0.5, 0.5], None)]), AB).collect()} == {"missing", "surplus"}
    assert matrices.aligned(rows.limit(0), matrix_of(spark, []), AB).count() == 0


def test_evaluation_of_logits(spark):
    rows = spark.createDataFrame([(0, [1, 0], [True, True], [0.0, 2.0]), (1, [0, 1], [False, True], [99.0, -1.0])], "row long, labels array<int>, label_mask array<boolean>, logits array<double>")
    scores, loss = matrices.evaluate_logits(rows)
    import math

    bce = lambda y, x: (1 - y) * x + math.log1p(math.exp(-x)) if x > 0 else (1 - y) * x + math.log1p(math.exp(x)) - x
    told = loss.first()
    assert told["valid"] == 3 and abs(told["loss"] - (bce(1, 0.0) + bce(0, 2.0) + bce(1, -1.0)) / 3) < 1e-9
    assert [round(s, 6) for s in scores.where("row = 0").first()["scores"]] == [0.5, round(1 / (1 + math.exp(-2)), 6)]
    assert matrices.evaluate_logits(rows.limit(0))[1].first()["loss"] == 0


def test_out_of_fold_cover(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "chunk_id string, fold int")
    schema = "fold int, chunk_id string, probabilities array<double>"
    good = [(0, "a", [0.1, 0.2]), (0, "b", [0.3, 0.4]), (1, "c", [0.5, 0.6])]
    assert matrices.oof_rows(rows, spark.createDataFrame(good, schema), AB).count() == 6
    for wrong in (good[:2], [*good, (1, "a", [0.1, 0.2])], [*good, good[0]], [*good[:2], (1, "c", [0.5, float("nan")])], [*good[:2], (1, "c", [0.5])], [*good[:2], (1, "c", None)]):
        with pytest.raises(ValueError):
            matrices.oof_rows(rows, spark.createDataFrame(wrong, schema), AB)


def test_external_scores_and_their_guards(spark):
    schema = "contract string, chunk_id string, probabilities array<double>"
    good = [("x", "1", [0.1, 0.9]), ("x", "2", [0.4, 0.2]), ("y", "3", [0.0, 1.0])]
    labels = spark.createDataFrame([(c, k, i, 1) for c in "xy" for i, k in enumerate(AB)], "contract string, category string, category_idx int, label int")
    run = {"smoke": False, "second_run": False, "chunks": 3, "contracts": 2, "thresholds": {"A": 0.5, "B": 0.6}}
    told, thresholds = matrices.external_scores(spark.createDataFrame(good, schema), run, labels, AB)
    assert thresholds == run["thresholds"] and {(r["contract"], r["category"]): r["score"] for r in told.collect()} == {("x", "A"): 0.4, ("x", "B"): 0.9, ("y", "A"): 0.0, ("y", "B"): 1.0}
    for change in ({"smoke": True}, {"second_run": True}, {"chunks": 4}, {"contracts": 3}, {"thresholds": {"A": 0.5}}, {"thresholds": {"A": 0.5, "B": 1.5}}, {"thresholds": None}):
        with pytest.raises(ValueError):
            matrices.external_scores(spark.createDataFrame(good, schema), run | change, labels, AB)
    for wrong in ([*good[:2], ("y", "2", [0.0, 1.0])], [*good[:2], ("y", "", [0.0, 1.0])], [*good[:2], ("z", "3", [0.0, 1.0])], [*good[:2], ("y", "3", [0.0, 2.0])], [*good[:2], (None, "3", [0.0, 1.0])]):
        with pytest.raises(ValueError):
            matrices.external_scores(spark.createDataFrame(wrong, schema), run, labels, AB)


def some_ledger(spark, path, arms, folds=3):
    rng = random.Random(3)
    rows = [(f"c{i % 12}", f"{i}", k, j, int(rng.random() < 0.4), rng.random() < 0.9, i % 12 % folds) for i in range(60) for j, k in enumerate(("Governing Law", "Exclusivity"))]
    rows = spark.createDataFrame(rows, "contract string, chunk_id string, category string, category_idx int, label int, mask boolean, fold int")
    runs = [(a, f, False, "l", "f", 2, 1e-5, 60.0 * (f + 1), 0.5) for a in arms for f in range(folds)]
    scores = [(a, i % 12 % folds, f"{i}", [round(rng.random(), 3) for _ in range(10)]) for a in arms for i in range(60)]
    runs, scores = spark.createDataFrame(runs, ledger.RUNS), spark.createDataFrame(scores, ledger.PREDICTIONS)
    ledger.record(path, runs, scores)
    return rows, runs, scores


def test_ledger_repeats_and_killed_runs(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    _, runs, scores = some_ledger(spark, path, ("bce", "focal"))
    read = lambda: [sorted(map(str, x.collect())) for x in ledger.read(spark, [path], "l", "f")]
    before = read()
    ledger.record(path, runs.where("arm = 'bce' and fold = 1"), scores.where("arm = 'bce' and fold = 1"))
    assert read() == before
    one = scores.where("arm = 'bce'").limit(3).withColumn("arm", F.lit("pos_weight")).withColumn("fold", F.lit(0))
    one.write.partitionBy("arm", "fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/predictions")  # killed before its row
    assert read() == before
    for labels, folds in (("other", "f"), ("l", "other")):
        with pytest.raises(ValueError):
            ledger.read(spark, [path], labels, folds)
    with pytest.raises(ValueError):
        ledger.read(spark, [path, path], "l", "f")
    ledger.record(f"{tmp_path}/smoke", runs.withColumn("smoke", F.lit(True)), scores)
    with pytest.raises(ValueError):
        ledger.read(spark, [f"{tmp_path}/smoke"], "l", "f")


def test_complete_folds_and_arms(spark):
    runs = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2), ("z", 0)], "arm string, fold int")
    arms = spark.createDataFrame([("a",), ("b",)], "arm string")
    folds = ledger.complete_folds(runs, arms)
    assert sorted(r[0] for r in folds.collect()) == [1, 2]
    assert sorted(map(tuple, ledger.ignored_runs(runs, folds).collect())) == [("a", 0), ("z", 0)]
    assert [r[0] for r in ledger.complete_arms(runs, runs.select("fold").distinct()).collect()] == ["a"]
    assert ledger.complete_folds(runs, arms.limit(0)).count() == 0


def test_summary_uses_complete_folds_only(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    rows, runs, scores = some_ledger(spark, path, ("bce", "focal"))
    short = runs.where("not (arm = 'focal' and fold = 2)")
    found = ledger.summarize(rows, short, scores, ("bce", "focal"), samples=20, weak=("Exclusivity",))
    kept = ledger.summarize(rows.where("fold <> 2"), runs.where("fold <> 2"), scores.where("fold <> 2"), ("bce", "focal"), samples=20, weak=("Exclusivity",))
    for name in ("summary", "per_category", "per_fold", "pairs"):
        assert sorted(map(str, found[name].collect())) == sorted(map(str, kept[name].collect())), name
    assert [tuple(r) for r in found["ignored"].collect()] == [("bce", 2)]
    told = {r["arm"]: r for r in found["summary"].collect()}
    assert set(told) == {"bce", "focal"} and told["bce"]["minutes_mean"] == 1.5 and 0 <= told["bce"]["macro_f1"] <= 1
    with pytest.raises(ValueError):
        ledger.summarize(rows, runs.where("fold = 0 or arm = 'bce'"), scores, ("bce", "focal"), samples=20)


def test_selection(spark, tmp_path):
    names = tuple(bootstrap.config_name(1e-5, e) for e in (1, 2))
    rows, runs, scores = some_ledger(spark, f"{tmp_path}/ledger", names)
    found = ledger.select(rows, runs.where(f"not (arm = '{names[1]}' and fold = 0)"), scores, samples=20)
    assert found["decision"].first()["pick"] == names[0] and [r[0] for r in found["incomplete"].collect()] == [names[1]]
    assert {r["category"] for r in found["thresholds"].collect()} == {"Governing Law", "Exclusivity"}
    with pytest.raises(ValueError):
        ledger.select(rows, runs.where("fold = 0"), scores, samples=20)
    told = spark.createDataFrame([(n,) for n in (*names, "lr2e-05-epx", "x")], "n string").select(bootstrap.parsed_config(F.col("n")).alias("p")).collect()
    assert [tuple(r["p"]) for r in told] == [(1e-5, 1), (1e-5, 2), (None, None), (None, None)]
    seeds = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "config string, f1 double")
    assert {tuple(r) for r in bootstrap.seed_summary(seeds, "f1").select("config", "seeds", "f1_mean").collect()} == {("a", 2, 2.0), ("b", 1, 2.0)}


def test_digests_and_the_chain(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", [1])], "n int, s string, v array<int>")
    assert manifest.digest(frame) == manifest.digest(frame.repartition(3).select("v", "s", "n"))
    assert len({manifest.digest(f) for f in (frame, frame.distinct(), frame.limit(0), frame.withColumn("n", F.col("n") + 1), frame.fillna("x"), frame.withColumn("v", F.lit(None).cast("array<int>")))}) == 5  # fillna changes nothing
    first = manifest.run_stage(spark, "one", {"raw": frame}, lambda raw: raw.select("n", "s"), f"{tmp_path}/one")
    made = spark.read.parquet(f"{tmp_path}/one/table")
    before = {"rows": f"{tmp_path}/one/manifest.json"}
    count = lambda f: f.agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), "n")
    second = manifest.run_stage(spark, "two", {"rows": made}, lambda rows: rows.distinct(), f"{tmp_path}/two", before, {"rows": 2}, count)
    assert second["before"] == {"rows": first["id"]} and second["counts"] == {"rows": 2}
    import hashlib

    names = {f["file"]: f["sha256"] for f in second["files"]}
    assert names == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "two" / "table").glob("part-*")}
    with pytest.raises(ValueError, match="is not what one wrote"):
        manifest.run_stage(spark, "two", {"rows": made.limit(1)}, lambda rows: rows, f"{tmp_path}/three", before)
    with pytest.raises(ValueError, match="counts differ"):
        manifest.run_stage(spark, "two", {"rows": made}, lambda rows: rows, f"{tmp_path}/four", before, {"rows": 2, "more": 1}, count)
    told = json.loads((tmp_path / "one" / "manifest.json").read_text())
    (tmp_path / "one" / "manifest.json").write_text(json.dumps(told | {"stage": "x"}))
    (tmp_path / "one" / ".manifest.json.crc").unlink()
    with pytest.raises(ValueError, match="was changed"):
        manifest.read_manifest(spark, f"{tmp_path}/one/manifest.json")


def test_lock_of_the_one_test_run(spark, tmp_path):
    rows = spark.createDataFrame([("c", "test"), ("d", "test")], "contract string, split string")
    run, path = {"smoke": False, "thresholds": {"A": 0.5}, "selected": {"A": 0.5}}, f"{tmp_path}/test_run.json"
    for wrong in (run | {"smoke": True}, run | {"selected": {"A": 0.6}}):
        with pytest.raises(ValueError):
            annotations.test_once(spark, rows, path, wrong)
    with pytest.raises(ValueError):
        annotations.test_once(spark, rows.union(spark.createDataFrame([("e", "train")])), path, run)
    assert not (tmp_path / "test_run.json").exists()
    told = annotations.test_once(spark, rows, path, run)
    assert told["chunks"] == 2 and json.loads((tmp_path / "test_run.json").read_text()) == told
    with pytest.raises(ValueError):
        annotations.test_once(spark, rows, path, run)
    assert annotations.test_once(spark, rows, path, run, again=True)["second_run"] and json.loads((tmp_path / "test_run.json").read_text()) == told


def test_claims_and_publication(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(annotations.claim(spark, {"i": i}, f"{tmp_path}/c.json"))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 5 + [True]
    for i in range(3):
        annotations.publish_json(spark, {"i": i}, f"{tmp_path}/p.json")
        assert json.loads((tmp_path / "p.json").read_text()) == {"i": i}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c.json", "p.json"]


def test_encoded_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    told = Tokenizer.from_file(path)
    rows = spark.createDataFrame([("a", "The law of Utah governs."), ("b", "x " * 70), ("c", "é")], "chunk_id string, text string")
    for r in encoding.encode(rows, path, begin=1, end=2, pad=9).collect():
        own = [1, *told.encode(r["text"], add_special_tokens=False).ids, 2]
        assert r["n_tokens"] == len(own) and r["size"] == -(-len(own) // 64) * 64
        assert r["ids"] == own + [9] * (r["size"] - len(own)) and r["attention"] == [1] * len(own) + [0] * (r["size"] - len(own))
    with pytest.raises(ValueError, match="'b'"):
        encoding.encode(rows, path, max_length=60)
    assert {r["size"] for r in encoding.encode(rows, path, max_length=150).collect()} == {64, 128}
    for wrong in (rows.union(rows), rows.union(spark.createDataFrame([("d", " ")])), rows.union(spark.createDataFrame([("d", None)], rows.schema))):
        with pytest.raises(ValueError):
            encoding.encode(wrong, path)


def test_report_guards(spark):
    chunks = spark.createDataFrame([("x", "1", "A", 0, 1, True, 0.7), ("x", "2", "A", 0, 0, False, 0.6), ("y", "3", "A", 0, 0, True, 0.8)], "contract string, chunk_id string, category string, category_idx int, label int, mask boolean, score double")
    truth = spark.createDataFrame([("x", "A", 1), ("y", "A", 0)], "contract string, category string, label int")
    found = report.evaluation_report(chunks, truth, {"half": 0.5, "high": 0.9}, categories=("A",)).collect()
    told = {(r["level"], r["configuration"], r["category"]): (r["support"], r["scored"], r["masked"], r["predicted_positive"], r["precision"], r["nothing_predicted"]) for r in found}
    assert told["chunk", "half", "A"] == (1, 2, 1, 2, 0.5, False) and told["contract", "high", "micro avg"] == (1, 2, 0, 0, 0.0, True) and len(told) == 12
    for args in ((chunks, truth.limit(1)), (chunks.where("contract = 'x'"), truth), (chunks.withColumn("score", F.lit(1.5)), truth)):
        with pytest.raises(ValueError):
            report.evaluation_report(*args, {"half": 0.5}, categories=("A",))
    with pytest.raises(ValueError):
        report.evaluation_report(chunks, truth, {"half": 0.5}, train=truth.limit(1), categories=("A",))


def test_nearest_evidence_against_all_spans(spark):
    rng = random.Random(5)
    spans = [(rng.choice("xy"), s, s + rng.randint(1, 30)) for s in (rng.randint(0, 400) for _ in range(25))]
    errors = [(rng.choice("xyz"), s, s + rng.randint(1, 40), i) for i, s in enumerate(rng.randint(0, 420) for _ in range(120))]
    got = {r["i"]: r["distance"] for r in report.nearest_evidence(spark.createDataFrame(errors, "contract string, start long, end long, i int"), spark.createDataFrame(spans, "contract string, start long, end long")).collect()}
    for c, a, b, i in errors:
        assert got[i] == min((max(s - b, a - e, 0) for k, s, e in spans if k == c), default=None)
