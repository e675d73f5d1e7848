import json

import pytest

from lexspan.functions.text import title_case
from lexspan.operators import checks, labeling, tables
from lexspan.plans import samples
from lexspan.schema import CATEGORIES
from lexspan.sources import annotations


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_flatten_merges_titles_and_questions(spark):
    flat = tables.flatten(samples.raw_json(spark))
    assert rows(tables.spans_of(flat), "contract", "category", "start", "end", "text") == sorted(samples.JSON_SPANS)
    assert {r["contract"]: r["text"][:5] for r in tables.contracts_of(flat).collect()} == {"Lease": "Lease", "Licence": "No pa"}


def test_build_write_and_load_a_split(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps(samples._RAW))
    split = annotations.load_split(spark, f"{tmp_path}/raw", f"{tmp_path}/cache", "train")
    assert rows(split["grid"].where("has_clause"), "contract", "category", "n_spans") == [("Lease", "Audit Rights", 1), ("Lease", "Governing Law", 1), ("Lease", "Renewal Term", 1), ("Licence", "Anti-Assignment", 1)]
    assert split["grid"].count() == 8
    (tmp_path / "raw" / "a.json").unlink()
    assert annotations.load_split(spark, f"{tmp_path}/raw", f"{tmp_path}/cache", "train")["spans"].count() == 4
    with pytest.raises(KeyError):
        annotations.load_split(spark, "", "", "other")


def test_offsets_must_match(spark):
    c = spark.createDataFrame([("a", "hello world")], "contract string, text string")
    good = spark.createDataFrame([("a", "x", 6, 11, "world")], "contract string, category string, start long, end long, text string")
    assert tables.offset_mismatches(c, good).isEmpty()
    assert tables.offset_mismatches(c, good.selectExpr("contract", "category", "start - 1 as start", "end", "text")).count() == 1


def test_quality_flags_and_cleaning(spark):
    df = spark.createDataFrame([("fee of [ *** ] due",), ("ﬁve  \n x",), ("",)], "text string")
    got = [tuple(r) for r in tables.quality_flags(df).select("text_clean", "has_redaction", "is_very_short", "whitespace_ratio").collect()]
    assert got == [("fee of [ *** ] due", True, False, 0.278), ("five x", False, True, 0.5), ("", False, True, 0.0)]


def test_title_case(spark):
    df = spark.createDataFrame([("non-compete",), ("cap ON liability",), ("it's",)], "t string")
    assert [r[0] for r in df.select(title_case(df.t)).collect()] == ["Non-Compete", "Cap On Liability", "It'S"]


def test_published_json_and_verified_write(spark, tmp_path):
    annotations.publish_json(spark, {"a": "é"}, f"file://{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "é"}
    frame = spark.range(5)
    assert annotations.verified_write(frame, f"{tmp_path}/t").count() == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        annotations.write_once(frame, f"{tmp_path}/t")
    assert "| id |" in annotations.markdown(frame)


def test_run_scan_guards(spark, tmp_path):
    schema = "arm string, fold int, smoke boolean, labels string"
    for i, fold in enumerate((0, 1)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"arm": "a", "fold": fold, "smoke": False, "labels": "h"}))
    assert annotations.scan_runs(spark, [str(tmp_path)], schema, ("arm", "fold"), {"labels": "h"}).count() == 2
    with pytest.raises(ValueError):
        annotations.scan_runs(spark, [str(tmp_path)], schema, ("arm",), {"labels": "h"})
    with pytest.raises(ValueError):
        annotations.scan_runs(spark, [str(tmp_path)], schema, ("arm", "fold"), {"labels": "other"})


WINDOWS = "contract string, chunk_id string, start long, end long"
SPANS = "contract string, category string, start long, end long"


def label(spark, windows, spans):
    w = spark.createDataFrame([("c", f"w{i}", a, b) for i, (a, b) in enumerate(windows)], WINDOWS)
    s = spark.createDataFrame([("c", k, a, b) for k, a, b in spans], SPANS)
    found = labeling.evidence(w, s)
    assert rows(found, *found.columns) == rows(labeling.evidence(w, s, bin_chars=7), *found.columns)
    labeled = labeling.labels_of(w, found)
    labeling.verify_labels(w, s, labeled)
    marks = {(r["chunk_id"], r["category"]): "+" if r["label"] else "?" for r in labeled.where("label = 1 or not mask").collect()}
    return marks, {r["name"]: r["value"] for r in labeling.report(labeled, found, w, s).collect()}


def test_touching_windows_do_not_overlap(spark):
    marks, report = label(spark, [(0, 10), (10, 20)], [("Governing Law", 10, 15)])
    assert marks == {("w1", "Governing Law"): "+"} and report["evidence"] == 1 and report["no_overlap"] == 1


def test_full_beats_partial_and_partial_masks(spark):
    marks, report = label(spark, [(0, 50)], [("Exclusivity", 10, 20), ("Exclusivity", 40, 80), ("Audit Rights", 45, 60)])
    assert marks == {("w0", "Exclusivity"): "+", ("w0", "Audit Rights"): "?"} and report["evidence"] == 3


def test_straddling_and_duplicate_spans(spark):
    marks, report = label(spark, [(0, 50), (40, 90)], [("Non-Compete", 30, 60), ("Governing Law", 42, 45), ("Governing Law", 42, 45)])
    assert marks == {("w0", "Non-Compete"): "?", ("w1", "Non-Compete"): "?", ("w0", "Governing Law"): "+", ("w1", "Governing Law"): "+"}
    assert (report["spans"], report["duplicate_spans"], report["uncovered_spans"], report["evidence"]) == (3, 1, 1, 4)


def test_no_spans_and_no_windows(spark):
    w = spark.createDataFrame([("c", "w", 0, 5)], WINDOWS)
    none = spark.createDataFrame([], SPANS)
    assert labeling.label_windows(w, none).where("label = 0 and mask").count() == len(CATEGORIES)
    assert labeling.label_windows(w.limit(0), none).count() == 0
    back = labeling.from_arrays(labeling.as_arrays(labeling.label_windows(w, none)))
    assert back.count() == len(CATEGORIES)


def test_tampered_labels_are_found(spark):
    w = spark.createDataFrame([("c", "w", 0, 5)], WINDOWS)
    labeled = labeling.label_windows(w, spark.createDataFrame([], SPANS))
    with pytest.raises(ValueError):
        labeling.verify_labels(w, spark.createDataFrame([], SPANS), labeled.selectExpr("chunk_id", "category", "1 as label", "mask"))
    with pytest.raises(ValueError):
        labeling.evidence(w.drop("start"), spark.createDataFrame([], SPANS))


@pytest.mark.parametrize("bad", [[0.5], {"Governing Law": 0.5}, float("nan"), -1.0])
def test_thresholds_are_validated(bad):
    with pytest.raises(ValueError):
        checks.threshold_values(bad)
