"""Queries of score matrices, run ledgers, manifests and reports, with their SQL; registered beside those of ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexspan.operators import bootstrap, encoding, ledger, manifest, matrices, metrics, report
from lexspan.operators.index import dense_index
from lexspan.operators.labeling import evidence
from lexspan.plans import bindings as B
from lexspan.plans import catalog
from lexspan.plans.bindings import with_sql
from lexspan.plans.catalog import query
from lexspan.schema import CATEGORIES
from lexspan.session import forget, shared_folder, spill


def _wide(spark, sf):
    """A row per window: arrays of labels, masks and scores in category order."""
    return B.wide(spark, sf).select("contract", "doc_id", "chunk_id", "fold", "labels", "label_mask", "scores")


# Score matrices -------------------------------------------------------------


@query("matrix_aligned", with_sql("SELECT chunk_id, category, CAST(category_idx AS INTEGER) AS category_idx, round(1 - score, 9) AS score FROM scored", "scored"))
def matrix_aligned(spark, sf):
    rows, _ = dense_index(spark, _wide(spark, sf), "row")
    matrix = rows.select("row", "chunk_id", F.transform("scores", lambda s: F.round(1 - s, 9)).alias("scores")).repartition(8, "row")
    return matrices.aligned(rows.select("row", "chunk_id"), matrix).select("chunk_id", "category", "category_idx", "score")


_LOGIT = "ln((score + 0.0005) / (1.0005 - score))"


@query("matrix_evaluate", with_sql(f"SELECT count(*) AS valid, round(avg((1 - label) * {_LOGIT} + ln(1 + exp(-abs({_LOGIT}))) + greatest(-({_LOGIT}), 0.0)), 8) AS loss, (SELECT round(avg(1 / (1 + exp(-({_LOGIT})))), 8) FROM scored) AS mean_score FROM scored WHERE mask", "scored"))
def matrix_evaluate(spark, sf):
    rows, _ = dense_index(spark, _wide(spark, sf).withColumn("logits", F.transform("scores", lambda s: F.log((s + 0.0005) / (1.0005 - s)))), "row")
    probabilities, loss = matrices.evaluate_logits(rows)
    told = matrices.aligned(rows.select("row", "chunk_id"), probabilities).agg(F.round(F.avg("score"), 8).alias("mean_score"))
    return loss.select("valid", F.round("loss", 8).alias("loss")).crossJoin(told)  # a row each


@query("matrix_out_of_fold", with_sql("SELECT chunk_id, fold, category, score FROM scored", "scored"))
def matrix_out_of_fold(spark, sf):
    rows, _ = spill(spark, _wide(spark, sf).select("fold", "chunk_id", "scores"))
    predictions = rows.select("fold", "chunk_id", F.col("scores").alias("probabilities"))
    return matrices.oof_rows(rows.select("chunk_id", "fold"), predictions).select("chunk_id", "fold", "category", "score")


@query("matrix_external_scores", with_sql("SELECT contract, category, max(score) AS score, max(label) AS label FROM scored GROUP BY ALL", "scored"))
def matrix_external_scores(spark, sf):
    rows, _ = spill(spark, _wide(spark, sf))
    export = rows.select("contract", "chunk_id", F.col("scores").alias("probabilities"))
    labels = B.scored(spark, sf).groupBy("contract", "category", "category_idx").agg(F.max("label").alias("label"))
    sizes = rows.agg(F.count("*").alias("chunks"), F.countDistinct("contract").alias("contracts")).first()
    run = sizes.asDict() | {"smoke": False, "second_run": False, "thresholds": dict.fromkeys(CATEGORIES, 0.5)}
    scored, _ = matrices.external_scores(export, run, labels)
    return scored.select("contract", "category", "score", "label")


# Run ledgers ----------------------------------------------------------------

_ARMS = tuple((a, m) for a, m in zip((*bootstrap.FIXES, bootstrap.CONTROL), (0.0, 0.02, 0.05, 0.1)))
#: One arm did not finish this fold.
_MISSING = ("focal", 4)


def _ledger(spark, sf):
    """A ledger in the shared folder: all arms on all folds but one, whose attempt did not end, and one arm written twice."""
    path = f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    rows, _ = spill(spark, _wide(spark, sf))
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(m).alias("moved")) for a, m in _ARMS))).alias("a")
    told = rows.select("fold", "chunk_id", "scores", arms).select("a.arm", "fold", "chunk_id", F.transform("scores", lambda s: F.greatest(s - F.col("a.moved"), F.lit(0.0))).alias("probabilities"))
    runs = told.groupBy("arm", "fold").agg(F.count("*").alias("n")).select("arm", "fold", F.lit(False).alias("smoke"), F.lit("l").alias("labels_digest"), F.lit("f").alias("folds_digest"), F.lit(3).alias("epochs"), F.lit(2e-5).alias("learning_rate"), F.col("n").cast("double").alias("seconds"), (F.col("fold") / 8).alias("loss"))
    ended = (F.col("arm") != _MISSING[0]) | (F.col("fold") != _MISSING[1])
    ledger.record(path, runs.where(ended), told)
    ledger.record(path, runs.where("arm = 'bce'"), told.where("arm = 'bce'"))  # repeated: changes nothing
    return path, *ledger.read(spark, [path], "l", "f")


_DIVISION = f"""arms(arm) AS (VALUES {', '.join(f"('{a}')" for a, _ in _ARMS)}),
runs AS (SELECT DISTINCT arm, fold FROM scored, arms WHERE NOT (arm = '{_MISSING[0]}' AND fold = {_MISSING[1]}))"""


@query("ledger_complete_folds", with_sql("SELECT DISTINCT fold FROM runs r WHERE NOT EXISTS (SELECT 1 FROM arms a WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.arm = a.arm AND s.fold = r.fold))", "scored", more=_DIVISION))
def ledger_complete_folds(spark, sf):
    path, runs, _ = _ledger(spark, sf)
    out, _ = spill(spark, ledger.complete_folds(runs, runs.select("arm")))
    forget(spark, path)
    return out


def _kept(sql: str) -> str:
    """The query on the rows of the folds that all arms finished."""
    return sql.replace("FROM scored_0)", f"FROM scored_0 WHERE fold <> {_MISSING[1]})", 1)


@query("ledger_summary", " UNION ALL ".join(f"SELECT config AS arm, macro_f1, macro_ap FROM {_kept(catalog._sweep_sql(a, m))}" for a, m in _ARMS))
def ledger_summary(spark, sf):
    path, runs, predictions = _ledger(spark, sf)
    found = ledger.compare(_wide(spark, sf).drop("scores"), runs, predictions, tuple(a for a, _ in _ARMS))
    out, _ = spill(spark, found["summary"].select("arm", "macro_f1", "macro_ap"))
    forget(spark, path)
    return out


@query("ledger_costs", with_sql("SELECT arm, count(*) AS seeds, avg(n) AS seconds_mean, round(stddev_samp(n), 6) AS seconds_std, avg(fold / 8.0::DOUBLE) AS loss_mean FROM runs JOIN (SELECT fold, CAST(count(DISTINCT chunk_id) AS DOUBLE) AS n FROM scored GROUP BY fold) USING (fold) GROUP BY arm", "scored", more=_DIVISION))
def ledger_costs(spark, sf):
    path, runs, _ = _ledger(spark, sf)
    out, _ = spill(spark, bootstrap.seed_summary(runs, "seconds", "loss", by="arm").select("arm", "seeds", "seconds_mean", F.round("seconds_std", 6).alias("seconds_std"), "loss_mean"))
    forget(spark, path)
    return out


# Manifests ------------------------------------------------------------------


def _digest_sql(columns: str) -> str:
    lane = lambda i: f"CAST(coalesce(sum(CAST('0x' || substr(h, {i}, 15) AS HUGEINT)), 0) % {1 << 60} AS BIGINT)"
    return f"SELECT {{stage}} AS stage, count(*) AS rows, {lane(1)} AS a, {lane(16)} AS b FROM (SELECT md5(concat_ws(chr(31), {columns})) AS h FROM {{source}})"


_STAGES = " UNION ALL ".join((
    _digest_sql("CAST(chunk_id AS VARCHAR), contract, CAST(doc_id AS VARCHAR), CAST(\"end\" AS VARCHAR), CAST(start AS VARCHAR)").format(stage="'windows'", source="windows"),
    _digest_sql("category, chunk_id, CAST(fully_contained AS VARCHAR)").format(stage="'evidence'", source="evidence"),
))


@query("manifest_chain", with_sql(_STAGES, "evidence"))
def manifest_chain(spark, sf):
    """Windows exported, then evidence from what was exported: the second stage checks the first's digest."""
    base = f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    windows = B.windows(spark, sf).select("contract", "doc_id", "chunk_id", "start", "end")
    first = manifest.run_stage(spark, "windows", {"windows": windows}, lambda windows: windows, f"{base}/windows")
    exported = spark.read.parquet(f"{base}/windows/table")
    spans = B.spans(spark, sf)
    count = lambda made: made.agg(F.count("*").alias("n")).select(F.lit("evidence").alias("name"), "n")
    expected = evidence(windows, spans).count()
    manifest.run_stage(spark, "evidence", {"windows": exported}, lambda windows: evidence(windows, spans).select("category", "chunk_id", "fully_contained"), f"{base}/evidence", {"windows": f"{base}/windows/manifest.json"}, {"evidence": expected}, count)
    assert first["output"] == manifest.digest(windows)
    parts = [manifest.digest_table(spark.read.parquet(f"{base}/{s}/table")).withColumn("stage", F.lit(s)) for s in ("windows", "evidence")]
    out, _ = spill(spark, parts[0].unionByName(parts[1]).select("stage", "rows", "a", "b"))
    forget(spark, base)
    return out


# Reports --------------------------------------------------------------------

_CONFIGS = {"default": 0.5, "tuned": dict.fromkeys(CATEGORIES, 0.5) | {"Governing Law": 0.3, "Audit Rights": 0.9}}


def _report_sql() -> str:
    parts = []
    for name, case in (("default", "0.5::DOUBLE"), ("tuned", catalog._TUNED_CASE)):
        chunk = catalog._AP + ",\n" + catalog._score_sql(case)
        for level, more in (("chunk", chunk), ("contract", catalog._POOLED + ",\nscored_all AS (SELECT * FROM scored),\n" + chunk.replace("FROM scored", "FROM pooled"))):
            parts.append("(" + with_sql(f"SELECT '{level}' AS level, '{name}' AS configuration, category, threshold, support, predicted_positive, precision, recall, f1, average_precision, support = 0 AS no_support, predicted_positive = 0 AS nothing_predicted FROM metric", "scored", more=more) + ")")
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


@query("report_evaluation", _report_sql())
def report_evaluation(spark, sf):
    stored, _ = spill(spark, _wide(spark, sf))
    rows = B.long(stored)
    truth, _ = spill(spark, rows.groupBy("contract", "category").agg(F.max("label").alias("label")))
    found = report.evaluation_report(rows, truth, _CONFIGS)
    return found.select("level", "configuration", "category", "threshold", "support", "predicted_positive", "precision", "recall", "f1", "average_precision", "no_support", "nothing_predicted")


_ERRORS = """wrong AS (SELECT s.contract, s.chunk_id, w.start, w."end", s.category, CASE WHEN score >= 0.5 THEN 'false positive' ELSE 'false negative' END AS kind FROM scored s JOIN windows w USING (chunk_id) WHERE mask AND label <> CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)"""


def _errors(spark, sf):
    decided = metrics.decisions(B.scored(spark, sf), 0.5)
    own = B.spans(spark, sf)
    return report.error_analysis(decided, evidence(B.windows(spark, sf), own), own)


@query("report_errors", with_sql("""SELECT kind, category, count(*) AS errors, CAST(sum(CASE WHEN d IS NULL OR d > 200 THEN 1 ELSE 0 END) AS BIGINT) AS nothing_near, sum(CASE WHEN d IS NULL OR d > 200 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share_nothing_near
FROM (SELECT chunk_id, category, kind, (SELECT min(greatest(s.start - w."end", w.start - s."end", 0)) FROM spans s WHERE s.contract = w.contract) AS d FROM wrong w) GROUP BY kind, category""", "scored", more=_ERRORS))  # fmt: skip
def report_errors(spark, sf):
    return _errors(spark, sf)["errors"]


@query("report_error_company", with_sql("SELECT kind, w.category, e.category AS other, count(*) AS n FROM wrong w JOIN (SELECT DISTINCT chunk_id, category FROM evidence) e ON e.chunk_id = w.chunk_id AND e.category <> w.category GROUP BY ALL", "scored", more=_ERRORS))
def report_error_company(spark, sf):
    return _errors(spark, sf)["company"]


# Training rows --------------------------------------------------------------


@query("encode_rows")
def encode_rows(spark, sf):
    import public_tokenizers

    rows = B.windows(spark, sf).select("chunk_id", "text").where("trim(text) <> ''")
    found = encoding.encode(rows, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("chunk_id", "n_tokens", "size", F.crc32(F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).cast("binary")).alias("ids_crc32"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).alias("attended"))


_BCE = f"((1 - label) * ({_LOGIT}) + (1 + (w - 1) * label) * (ln(1 + exp(-abs({_LOGIT}))) + greatest(-({_LOGIT}), 0.0)))"


@query("arm_losses", with_sql(f"""SELECT arm, category, round(avg(CASE WHEN arm = 'focal' THEN (CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - exp(-{_BCE}), 2) * {_BCE} ELSE {_BCE} END), 8) AS loss
FROM (SELECT s.*, a.arm, CASE WHEN arm = 'pos_weight' THEN r.w ELSE 1.0::DOUBLE END AS w FROM scored s JOIN ratios r USING (category), (VALUES ('bce'), ('pos_weight'), ('focal'), ('downsample')) a(arm) WHERE mask) GROUP BY arm, category""", "scored", more="ratios AS (SELECT category, sum(1 - label) / CAST(sum(label) AS DOUBLE) AS w FROM scored WHERE mask GROUP BY category)"))  # fmt: skip
def arm_losses(spark, sf):
    rows = B.scored(spark, sf).withColumn("logit", F.log((F.col("score") + 0.0005) / (1.0005 - F.col("score"))))
    return encoding.arm_losses(rows, rows).withColumn("loss", F.round("loss", 8))
