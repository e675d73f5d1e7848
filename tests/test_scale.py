"""Steps that must not do more work than once a row, and sizes that must grow with the input."""

import re

import pytest
from lexspan.operators import chunking, linear, risk, rules
from lexspan.plans import catalog
from pyspark.sql import functions as F


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_nested_files_grow_with_the_corpus():
    assert catalog._files(0) == 16 and catalog._files(10**9) * catalog._FILE_CHARS >= 10**9


def test_explain_runs_a_pattern_once(spark):
    rule = rules.Rule("Audit Rights", "license", r"\blicen[cs]e\b")
    rows = spark.createDataFrame([("a", "\U0001f600 the License, the license"), ("b", "none"), ("c", "license"), ("d", None)], "chunk_id string, text string")
    found = rules.explain(rows, (rule,))
    assert sorted(map(tuple, found.select("chunk_id", "start", "end", "match").collect())) == [("a", 6, 13, "License"), ("c", 0, 7, "license")]
    assert plan(found).count("licen[cs]e") == 1


def test_rule_stats_reads_the_rules_once(spark):
    told = (rules.Rule("Audit Rights", "x", "xx"), rules.Rule("Audit Rights", "y", "yy"), rules.Rule("Audit Rights", "z", "zz"))
    rows = spark.createDataFrame([("a", "xx yy"), ("b", "xx"), ("c", "none"), ("d", "yy")], "chunk_id string, text string")
    labeled = spark.createDataFrame([("a", "Audit Rights", 1, True), ("b", "Audit Rights", 1, True), ("c", "Audit Rights", 1, True), ("d", "Audit Rights", 0, False)], "chunk_id string, category string, label int, mask boolean")
    every = spark.createDataFrame([(r.category, r.name) for r in told], "category string, rule string")
    found = rules.rule_stats(labeled, rules.rule_hits(rows, told, fired=True), every)
    assert plan(found).count("RLIKE") <= len(told)
    assert sorted(map(str, found.collect())) == sorted(map(str, rules.rule_stats(labeled, rules.rule_hits(rows, told)).collect()))


def test_patterns_of_other_categories_do_not_run(spark):
    rows = spark.createDataFrame([("a", "Audit Rights", "without notice"), ("b", "Renewal Term", "without notice"), ("c", "Audit Rights", None)], "chunk_id string, category string, text string")
    found = risk.adjustments(rows)
    assert sorted(map(tuple, found.select("chunk_id", "adjustment", "matched", "words").collect())) == [("a", "audit_without_notice", True, "without notice"), ("b", "renewal_no_opt_out", False, None), ("c", "audit_without_notice", False, None)]
    assert plan(found).count("(?iU)^([") == 0


def test_windows_are_counted_without_listing():
    text = "One two. Three\x1cfour  five  six. " * 9
    assert chunking.make_counter("words")(text) == len(chunking.make_tokenizer("words")(text))
    listed = []

    def tokenize(part):
        listed.append(part)
        return chunking.word_offsets(part)

    want = list(chunking.cut(text, chunking.word_offsets, chunking.Config(7, 2)))
    assert list(chunking.cut(text, tokenize, chunking.Config(7, 2), count=chunking.make_counter("words"))) == want and len(want) > 5
    assert listed == [text]


def test_optimiser_keeps_nothing_as_long_as_the_dictionary():
    assert not re.search(r"span: int|size \* width", linear._STATE) and "vectors" in linear._STATE and hasattr(linear, "_line")
    steps = linear._GRID * 0.5
    assert abs(linear._step(steps - 0.3, steps) - 0.3) < 1e-12 and linear._step(steps - 100, steps) == steps[-1]


def test_weights_move_a_blocks_terms_once(spark):
    from lexspan.operators import tfidf

    rows = spark.createDataFrame([("a", "x", "red blue red"), ("b", "y", "red green"), ("c", None, "blue green"), ("d", "x", None), ("e", "y", "")], "contract string, lang string, text string")
    held = tfidf.WEIGHT_CHARS
    tfidf.WEIGHT_CHARS = 10
    found = tfidf.weights(rows, "contract", carry=("lang",))
    told = {(r["contract"], r["lang"], r["term"]): r["weight"] for r in found.collect()}
    tfidf.WEIGHT_CHARS = held
    assert set(told) == {("a", "x", "red"), ("a", "x", "blue"), ("b", "y", "red"), ("b", "y", "green"), ("c", None, "blue"), ("c", None, "green")}
    assert abs(told["a", "x", "red"] ** 2 + told["a", "x", "blue"] ** 2 - 1) < 1e-8 and abs(told["c", None, "blue"] - 0.5**0.5) < 1e-8


def test_resampled_sums_are_drawn_once(spark):
    from lexspan.operators import bootstrap

    rows = [("a", f"c{i}", k, i % 3, i % 2, 1) for i in range(9) for k in ("Exclusivity", "Governing Law")] + [("b", "c1", "Exclusivity", 5, 0, 0)]
    counts = spark.createDataFrame(rows, "arm string, contract string, category string, tp long, fp long, fn long")
    sums = bootstrap.resampled_sums(counts, 5)
    assert "MapInArrow" not in plan(sums) and "Aggregate" not in plan(sums)
    told = {(r["arm"], r["category"], r["sample"]): r["tp"] for r in sums.collect()}
    assert len(told) == 3 * 6 and told["a", "Exclusivity", -1] == 9 and told["b", "Exclusivity", -1] == 5


def test_pooled_scores_are_made_once(spark):
    from lexspan.operators import metrics

    rows = spark.createDataFrame([("x", "A", 0, 0.7, 1), ("x", "A", 0, 0.9, 0)], "contract string, category string, category_idx int, score double, label int")
    found = metrics.pool_contracts(rows)
    assert "Aggregate" not in plan(found) and tuple(found.select("score", "label", "mask").first()) == (0.9, 1, True)


def test_windows_meet_their_evidence_before_categories(spark):
    from lexspan.operators import labeling

    windows = spark.createDataFrame([("x", "w1"), ("x", "w2"), ("x", None)], "contract string, chunk_id string")
    found = spark.createDataFrame([("w1", "A", True), ("w1", "A", False), ("w2", "B", False), ("w2", "other", True)], "chunk_id string, category string, fully_contained boolean")
    told = labeling.labels_of(windows, found, ("A", "B"))
    lines = plan(told).splitlines()
    depth = lambda word: min(i for i, line in enumerate(lines) if word in line)
    assert depth("Generate") < depth("Join")
    assert sorted(map(tuple, told.select("chunk_id", "category", "category_idx", "label", "mask").collect()), key=str) == sorted(
        [("w1", "A", 0, 1, True), ("w1", "B", 1, 0, True), ("w2", "A", 0, 0, True), ("w2", "B", 1, 0, False), (None, "A", 0, 0, True), (None, "B", 1, 0, True)], key=str
    )


def test_windows_are_split_before_their_categories(spark, tmp_path):
    docs = [(i, "a b " * 150, "en", "s") for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["fold_split"](spark, str(tmp_path))
    lines = plan(found).splitlines()
    assert min(i for i, line in enumerate(lines) if "Generate" in line) < min(i for i, line in enumerate(lines) if "Join" in line)
    assert {r["n"] for r in found.collect()} == {8 * 2} and found.count() == 10


def test_predictions_are_joined_as_arrays(spark):
    from lexspan.operators import matrices

    rows = spark.createDataFrame([("1", 0), ("2", 1)], "chunk_id string, fold int")
    told = spark.createDataFrame([(0, "1", [0.1, 0.2]), (1, "2", [0.3, 0.4])], "fold int, chunk_id string, probabilities array<double>")
    found = matrices.oof_rows(rows, told, ("A", "B"))
    lines = plan(found).splitlines()
    assert min(i for i, line in enumerate(lines) if "Generate" in line) < min(i for i, line in enumerate(lines) if "Join" in line)
    assert sorted(map(tuple, found.select("chunk_id", "category", "category_idx", "score").collect())) == [("1", "A", 0, 0.1), ("1", "B", 1, 0.2), ("2", "A", 0, 0.3), ("2", "B", 1, 0.4)]


def test_a_ledger_keeps_windows_not_their_categories(spark):
    from lexspan.operators import ledger
    from lexspan.schema import CATEGORIES

    kinds = ("Governing Law", "Exclusivity", "not known")  # not in the order of the matrix
    rows = [(f"c{i}", f"{i}", k, j, i % 2, i != 3, i % 2) for i in range(8) for j, k in enumerate(kinds)]
    rows = spark.createDataFrame(rows, "contract string, chunk_id string, category string, category_idx int, label int, mask boolean, fold int")
    scores = [(a, i % 2, f"{i}", [((i * 7 + k * 3 + n) % 10) / 10 for k in range(len(CATEGORIES))]) for n, a in enumerate(("bce", "focal")) for i in range(8)]
    told = spark.createDataFrame(scores, ledger.PREDICTIONS)
    runs = spark.createDataFrame([(a, f, False, "l", "f", 1, 1e-5, 1.0, 0.5) for a in ("bce", "focal") for f in (0, 1)], ledger.RUNS)
    found = ledger.summarize(rows, runs, told, ("bce", "focal"), samples=4, weak=("Exclusivity",))
    assert "Generate" in plan(found["decided"])
    given = {(a, c): p for a, _, c, p in scores}
    decided = found["decided"].collect()
    assert len(decided) == 2 * 8 * 2 and all(r["score"] == given[r["arm"], r["chunk_id"]][CATEGORIES.index(r["category"])] for r in decided)
    for wrong in (told.where("arm = 'bce' or chunk_id <> '5'"), told.union(told.where("arm = 'focal' and chunk_id = '2'")), told.withColumn("fold", 1 - told["fold"])):
        with pytest.raises(ValueError):
            ledger.summarize(rows, runs, wrong, ("bce", "focal"), samples=4)


def test_report_comes_from_stored_counts(spark):
    from lexspan.operators import report

    chunks = spark.createDataFrame([("x", "1", "A", 0, 1, True, 0.7), ("x", "2", "A", 0, 0, False, 0.6), ("y", "3", "A", 0, 0, True, 0.8)], "contract string, chunk_id string, category string, category_idx int, label int, mask boolean, score double")
    truth = spark.createDataFrame([("x", "A", 1), ("y", "A", 0)], "contract string, category string, label int")
    found = report.evaluation_report(chunks, truth, {"half": 0.5, "high": 0.9}, categories=("A",))
    assert "LogicalRDD" not in plan(found) and "LocalRelation" not in plan(found)
    told = {(r["level"], r["configuration"], r["category"]): (r["support"], r["masked"], r["predicted_positive"], r["average_precision"]) for r in found.collect()}
    assert told["chunk", "half", "A"] == (1, 1, 2, 0.5) and told["contract", "half", "A"] == (1, 0, 2, 0.5) and told["chunk", "high", "macro avg"] == (1, 1, 0, 0.5)


def test_rows_are_checked_in_one_pass_and_padded_together(spark, monkeypatch):
    import public_tokenizers
    from lexspan.operators import encoding
    from tokenizers import Tokenizer

    calls = []
    monkeypatch.setattr(encoding, "require_empty", lambda rows, message: calls.append(rows.count()))
    path = public_tokenizers.path("byte_bpe_50k.json")
    told = Tokenizer.from_file(path)
    texts = {f"{i}": "law of Utah \U0001f600 " * n for i, n in enumerate((1, 40, 9, 12, 13, 64))}
    rows = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").coalesce(1)
    for around in ({}, {"begin": 1}, {"end": 2}, {"begin": 1, "end": 2}):
        for r in encoding.encode(rows, path, max_length=4096, pad=7, bucket=32, **around).collect():
            own = [*([1] if "begin" in around else []), *told.encode(texts[r["chunk_id"]], add_special_tokens=False).ids, *([2] if "end" in around else [])]
            size = -(-len(own) // 32) * 32
            assert (r["n_tokens"], r["size"], r["ids"], r["attention"]) == (len(own), size, own + [7] * (size - len(own)), [1] * len(own) + [0] * (size - len(own)))
    assert calls == [0] * 4


def test_an_evaluation_moves_no_terms(spark, monkeypatch):
    from lexspan.operators import tfidf

    texts = [" ".join(f"w{(i * k) % 41}" for k in range(1, 30)) for i in range(24)]
    rows = [(f"c{i}", str(i), t, i % 2, "A", 0, int(i % 3 == 0), True) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "contract string, chunk_id string, text string, fold int, category string, category_idx int, label int, mask boolean")
    monkeypatch.setattr(linear, "RANGE", 20)
    monkeypatch.setattr(linear, "BLOCK_TERMS", 200)
    plans, tiles, evaluated, dealt = [], [], linear._evaluated, linear._tiles

    def noted(*args):
        out = evaluated(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def kept(session, blocks, *args):
        out = dealt(session, blocks, *args)
        count = lambda table, column: table.selectExpr(f"sum(length({column}))").first()[0]
        tiles.append((out.table.select("tile").distinct().count(), len(out.begins), count(out.table, "places"), count(blocks, "columns")))
        return out

    monkeypatch.setattr(linear, "_evaluated", noted)
    monkeypatch.setattr(linear, "_tiles", kept)
    tfidf.fit_folds(frame)
    assert len(tiles) == 1 and tiles[0][0] == tiles[0][1] > 1 and tiles[0][2] == tiles[0][3] > 0
    for told in plans:
        moved = re.findall(r"Exchange (\w+)\((\w+)", told)
        assert sorted(moved) == [("hashpartitioning", "block"), ("hashpartitioning", "tile")]  # rows' numbers there and back; tiles and rows lie still


def test_terms_move_packed_and_their_counts_come_back_alone(spark):
    import math

    import pyarrow as pa
    from lexspan.operators import tfidf

    texts = {"a": "Änderung nach Änderung", "b": "nach Änderung x", "c": None, "d": "  ", "e": "rot nach"}
    rows = spark.createDataFrame(list(texts.items()), "contract string, text string")
    held, tfidf.WEIGHT_CHARS = tfidf.WEIGHT_CHARS, 8
    found = tfidf.weights(rows, "contract")
    told = {(r["contract"], r["term"]): r["weight"] for r in found.collect()}
    tfidf.WEIGHT_CHARS = held
    assert "Window" not in plan(found) and "array_join" in plan(found)
    twice, once, pair = (1 + math.log(2)) * (math.log(6 / 3) + 1), math.log(6 / 3) + 1, math.log(6 / 4) + 1
    assert set(told) == {("a", "änderung"), ("a", "nach"), ("a", "nach änderung"), ("b", "änderung"), ("b", "nach"), ("b", "nach änderung"), ("e", "nach")}
    assert abs(told["a", "änderung"] - twice / math.sqrt(twice**2 + once**2 + pair**2)) < 1e-6 and told["e", "nach"] == pytest.approx(1, abs=1e-6)
    sent = [(b, 0, *tfidf._packed(tfidf._lines(pa.array(names))), tfidf._packed(b"\x01\0\0\0" * len(names))[1]) for b, names in ((3, ["rot", "blau"]), (4, ["blau"]))]
    back = tfidf._counted(pa.table([pa.array(list(v)) for v in zip(*sent)], names=["block", "range", "size", "terms", "docs"]))
    assert back.column_names == ["block", "range", "size", "df"]
    assert [tfidf._unpacked(r["size"], r["df"]) for r in back.to_pylist()] == [b"\x01" + b"\0" * 7 + b"\x02" + b"\0" * 7, b"\x02" + b"\0" * 7]


def test_a_fit_takes_few_evaluations(spark):
    from lexspan.operators import tfidf

    texts = [" ".join(f"w{(i * k * k) % 97}" for k in range(1, 12 + i % 9)) + " all of them" for i in range(150)]
    rows = [(f"c{i}", str(i), t, "A", 0, int(i * i % 7 < 3), True) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "contract string, chunk_id string, text string, category string, category_idx int, label int, mask boolean")
    assert tfidf._fit(frame, [], True, tfidf.Config(tolerance=1e-6), "text").evaluations <= 28  # 37 with one direction of L-BFGS


def test_basis_is_orthonormal():
    import numpy as np

    vectors = np.zeros((linear._VECTORS, 50))
    vectors[:5] = np.random.default_rng(3).standard_normal((5, 50)) * 10.0 ** np.arange(0, -10, -2)[:, None]
    vectors[6] = 3 * vectors[2]  # adds nothing
    basis = linear._basis(vectors @ vectors.T)
    made = basis.T @ vectors
    assert basis[0].any() == False and np.allclose(made[:4] @ made[:4].T, np.eye(4), atol=1e-6) and not made[4:].any()  # noqa: E712  the point itself is none of them
