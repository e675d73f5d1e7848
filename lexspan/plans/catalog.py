"""Every query of the library by name, on the driver's tables, with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import bootstrap, checks, chunking, folds, labeling, metrics, risk, rules, summaries, tables, tfidf
from lexspan.plans import bindings as B
from lexspan.plans import samples
from lexspan.plans.bindings import with_sql
from lexspan.schema import CATEGORIES, FINE_GRID, SHORT_SPAN, TUNING_GRID, WEAK_CATEGORIES
from lexspan.session import forget, shared_folder, spill, table
from lexspan.sources import annotations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _fixed(x: str) -> str:
    return f"CAST(floor(({x}) * {metrics.SCALE}.0) AS BIGINT)"


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda v: "NULL" if v is None else "TRUE" if v is True else "FALSE" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


# Scans and projections ------------------------------------------------------


@query("scan_contracts", with_sql("SELECT contract, split, n_chars FROM contracts", "contracts"))
def scan_contracts(spark, sf):
    return B.contracts(spark, sf).select("contract", "split", "n_chars")


@query("scan_conversations", "SELECT CAST(conv_id AS VARCHAR) AS contract, concat_ws(':', conv_id, turn) AS chunk_id, CAST(length(text) AS BIGINT) AS n_chars FROM conversations")
def scan_conversations(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("contract"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.length("text").cast("long").alias("n_chars"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"


#: Characters of a nested JSON file, which is written and parsed as a whole.
_FILE_CHARS = 1 << 21


def _files(chars: int) -> int:
    """How many nested JSON files a corpus has: files stay small, their number grows."""
    return max(16, -(-chars // _FILE_CHARS))


@query("scan_nested_json", with_sql("SELECT contract, category, start, \"end\", text FROM spans", "spans"))
def scan_nested_json(spark, sf):
    """The spans are written as nested JSON files, a few contracts each, and read back."""
    path = _folder(spark)
    rows = B.annotations(spark, sf)
    n = _files(B.contracts(spark, sf).agg(F.sum("n_chars")).first()[0] or 0)
    rows = rows.withColumn("file", F.pmod(F.xxhash64("contract"), F.lit(n)))
    files = rows.groupBy("file").agg(F.to_json(F.struct(F.lit("t").alias("version"), F.collect_list("entry").alias("data"))).alias("value"))  # a file's entries
    files.write.partitionBy("file").text(path)
    found = tables.spans_of(tables.flatten(annotations.read_annotations(spark, f"{path}/file=*")))
    out, _ = spill(spark, found.select("contract", "category", "start", "end", "text"))
    forget(spark, path)
    return out


_NAMES = r"names AS (SELECT DISTINCT replace(source, '_', ' ') AS raw, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


@query("scan_category_descriptions", f"""WITH {_NAMES} SELECT list_aggregate(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(raw[i - 1], '\\p{{L}}') THEN upper(raw[i]) ELSE lower(raw[i]) END), 'string_agg', '') AS category, raw AS category_raw, 'Is it "' || raw || '", or not?' || chr(10) || 'in ' || lang AS description, 'Yes/No' AS answer_format, CASE WHEN lang <> 'en' THEN NULL ELSE upper(raw) END AS json_category FROM names""")
def scan_category_descriptions(spark, sf):
    """Descriptions of the documents' sources are written as CSV, with quotes and line breaks in values, and read back."""
    path = _folder(spark)
    docs = table(spark, sf, "documents").where("source is not null and lang is not null")
    raw = F.translate("source", "_", " ")
    rows = docs.select(raw.alias("raw"), "lang").distinct()
    told = rows.select(F.concat(F.lit("Category: "), "raw").alias("Category"), F.concat(F.lit('Description: Is it "'), "raw", F.lit('", or not?\nin '), "lang").alias("Description"), F.lit("Answer Format: Yes/No").alias("Answer Format"), F.concat(F.lit("Group: "), "lang").alias("Group"))
    told.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    known = rows.select(F.upper("raw").alias("category")).distinct()
    found = annotations.match_categories(annotations.read_descriptions(spark, path), known)
    json = F.when(F.col("group") == "en", F.col("json_category")).alias("json_category")
    out, _ = spill(spark, found.select("category", "category_raw", "description", "answer_format", json))
    forget(spark, path)
    return out


@query("proj_spans", with_sql("SELECT contract, category, start, \"end\", \"end\" - start AS n_chars_span, CAST(start AS DOUBLE) / n_chars AS rel_position FROM spans", "spans"))
def proj_spans(spark, sf):
    return B.spans(spark, sf).select("contract", "category", "start", "end", (F.col("end") - F.col("start")).alias("n_chars_span"), F.try_divide("start", "n_chars").alias("rel_position"))


@query("proj_quality_flags", with_sql(rf"""SELECT contract, category, start, regexp_matches(text, '\[\s*\*+\s*\]') AS has_redaction, length(text) < {SHORT_SPAN} AS is_very_short,
round_even(length(regexp_replace(text, '[^ \t\n\r\f\v]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 3) AS whitespace_ratio FROM spans""", "spans"))  # fmt: skip
def proj_quality_flags(spark, sf):
    return tables.quality_flags(B.spans(spark, sf), clean=False).select("contract", "category", "start", "has_redaction", "is_very_short", "whitespace_ratio")


@query("proj_clean_text", with_sql(r"SELECT contract, category, start, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text_clean FROM spans", "spans"))
def proj_clean_text(spark, sf):
    return B.spans(spark, sf).select("contract", "category", "start", tables.clean_text(F.col("text")).alias("text_clean"))


@query("proj_priority_filter", with_sql("SELECT contract, category, start, \"end\" FROM spans WHERE category IN ('Governing Law', 'Audit Rights')", "spans"))
def proj_priority_filter(spark, sf):
    return tables.priority(B.spans(spark, sf), ("Governing Law", "Audit Rights")).select("contract", "category", "start", "end")


@query("proj_apply_thresholds", with_sql("SELECT chunk_id, category, CASE WHEN score >= CASE category WHEN 'Governing Law' THEN 0.3 WHEN 'Audit Rights' THEN 0.9 ELSE 0.5 END THEN 1 ELSE 0 END AS decision FROM scored", "scored"))
def proj_apply_thresholds(spark, sf):
    thresholds = dict.fromkeys(CATEGORIES, 0.5) | {"Governing Law": 0.3, "Audit Rights": 0.9}
    return metrics.decisions(B.scored(spark, sf), thresholds).select("chunk_id", "category", "decision")


@query("proj_train_validation_role", with_sql("SELECT contract, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS role FROM contracts", "contracts"))
def proj_train_validation_role(spark, sf):
    return B.contracts(spark, sf).select("contract", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("role"))


@query("proj_flag_concat", with_sql("SELECT contract, concat_ws('; ', CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END) AS flag FROM contracts", "contracts"))
def proj_flag_concat(spark, sf):
    return B.contracts(spark, sf).select("contract", F.concat_ws("; ", F.when(F.col("n_chars") > 3000, "long"), F.when(F.col("doc_id") % 2 == 0, "even")).alias("flag"))


# Joins ----------------------------------------------------------------------

_GRID = """kinds AS (SELECT DISTINCT category FROM spans), counted AS (SELECT contract, category, count(*) AS n FROM spans GROUP BY ALL),
grid AS (SELECT c.contract, c.split, k.category, coalesce(n, 0) AS n_spans, coalesce(n, 0) > 0 AS has_clause FROM contracts c CROSS JOIN kinds k LEFT JOIN counted s ON s.contract = c.contract AND s.category = k.category)"""


def _grid(spark, sf):
    return tables.presence_grid(B.contracts(spark, sf), B.spans(spark, sf))


@query("join_grid", with_sql("SELECT contract, category, n_spans, has_clause FROM grid", "spans", more=_GRID))
def join_grid(spark, sf):
    return _grid(spark, sf)


@query("join_evidence", with_sql("SELECT * FROM evidence", "evidence"))
def join_evidence(spark, sf):
    return labeling.evidence(B.windows(spark, sf), B.spans(spark, sf))


@query("join_evidence_binned", with_sql("SELECT * FROM evidence", "evidence"))
def join_evidence_binned(spark, sf):
    return labeling.evidence(B.windows(spark, sf), B.spans(spark, sf), bin_chars=1000)


def _some_folds(spark, sf):
    return B.contracts(spark, sf).where("doc_id % 7 <> 0").select("contract", (F.col("doc_id") % 5).cast("int").alias("fold"))


@query("join_fold_lookup", with_sql("SELECT chunk_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 5 AS INTEGER) END AS fold FROM windows", "windows"))
def join_fold_lookup(spark, sf):
    return B.windows(spark, sf).select("contract", "chunk_id").join(_some_folds(spark, sf), "contract", "left").select("chunk_id", "fold")


@query("join_missing_fold", with_sql("SELECT contract FROM contracts WHERE doc_id % 7 = 0", "contracts"))
def join_missing_fold(spark, sf):
    return B.contracts(spark, sf).join(_some_folds(spark, sf), "contract", "left_anti").select("contract")


@query("join_semi_priority", with_sql("SELECT contract, split FROM contracts WHERE contract IN (SELECT contract FROM spans WHERE category = 'Governing Law')", "spans"))
def join_semi_priority(spark, sf):
    return B.contracts(spark, sf).join(B.spans(spark, sf).where("category = 'Governing Law'"), "contract", "left_semi").select("contract", "split")


_HELD = 'EXISTS (SELECT 1 FROM windows w WHERE w.contract = s.contract AND w.start <= s.start AND s."end" <= w."end")'


@query("join_span_contained", with_sql(f'SELECT contract, category, start, "end" FROM spans s WHERE {_HELD}', "spans", "windows"))
def join_span_contained(spark, sf):
    return labeling.contained_spans(B.windows(spark, sf), B.spans(spark, sf)).select("contract", "category", "start", "end")


@query("join_span_uncovered", with_sql(f'SELECT contract, category, start, "end" FROM spans s WHERE NOT {_HELD}', "spans", "windows"))
def join_span_uncovered(spark, sf):
    return labeling.uncovered_spans(B.windows(spark, sf), B.spans(spark, sf)).select("contract", "category", "start", "end")


@query("join_verify_offsets", with_sql("SELECT s.contract, s.category, s.start FROM (SELECT contract, category, CASE WHEN start % 10 = 0 THEN start + 1 ELSE start END AS start, \"end\", text FROM spans) s JOIN contracts c USING (contract) WHERE substring(c.text, start + 1, greatest(\"end\" - start, 0)) <> s.text", "spans"))
def join_verify_offsets(spark, sf):
    moved = B.spans(spark, sf).withColumn("start", F.when(F.col("start") % 10 == 0, F.col("start") + 1).otherwise(F.col("start")))
    return tables.offset_mismatches(B.contracts(spark, sf), moved).select("contract", "category", "start")


@query("join_cooccurrence", with_sql("SELECT a.category AS category_a, b.category AS category_b, count(*) AS n_contracts FROM (SELECT DISTINCT contract, category FROM spans) a JOIN (SELECT DISTINCT contract, category FROM spans) b USING (contract) GROUP BY ALL", "spans"))
def join_cooccurrence(spark, sf):
    return summaries.cooccurrence(_grid(spark, sf))


@query("join_density", with_sql("SELECT contract, n_chars, CAST(sum(CAST(has_clause AS INTEGER)) AS BIGINT) AS n_present FROM contracts JOIN grid USING (contract) GROUP BY ALL", "spans", more=_GRID))
def join_density(spark, sf):
    return summaries.density(B.contracts(spark, sf), _grid(spark, sf))


@query("agg_density_correlation", with_sql('SELECT round(corr(n, l), 9) AS correlation FROM (SELECT max(n_chars) AS n, sum("end" - start) AS l FROM spans GROUP BY contract)', "spans"))
def agg_density_correlation(spark, sf):
    rows = B.spans(spark, sf).groupBy("contract").agg(F.max("n_chars").alias("n"), F.sum(F.col("end") - F.col("start")).alias("l"))
    return rows.agg(F.round(F.corr("n", "l"), 9).alias("correlation"))


# Aggregations ---------------------------------------------------------------

_COVER = "SELECT category, CAST(sum(CAST(has_clause AS INTEGER)) AS BIGINT) AS n_contracts, round(100 * sum(CAST(has_clause AS INTEGER)) / CAST(count(*) AS DOUBLE), 1) AS pct FROM grid"


@query("agg_coverage", with_sql(f"{_COVER} GROUP BY category", "spans", more=_GRID))
def agg_coverage(spark, sf):
    return summaries.coverage(_grid(spark, sf))


@query("agg_coverage_gap", with_sql(f"SELECT category, a.pct AS pct_a, b.pct AS pct_b, abs(a.pct - b.pct) AS pct_gap FROM ({_COVER} WHERE split = 'train' GROUP BY category) a LEFT JOIN ({_COVER} WHERE split = 'test' GROUP BY category) b USING (category)", "spans", more=_GRID))
def agg_coverage_gap(spark, sf):
    grid = _grid(spark, sf).join(B.contracts(spark, sf).select("contract", "split"), "contract")
    return summaries.coverage_gap(grid.where("split = 'train'"), grid.where("split = 'test'"))


@query("agg_length_stats", with_sql('SELECT category, count(*) AS n, median("end" - start) AS median, avg("end" - start) AS mean, max("end" - start) AS longest FROM spans GROUP BY category', "spans"))
def agg_length_stats(spark, sf):
    return summaries.length_stats(B.spans(spark, sf), F.col("end") - F.col("start"))


@query("agg_describe", with_sql("SELECT count(n_chars) AS count, avg(n_chars) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS max FROM contracts", "contracts"))
def agg_describe(spark, sf):
    return summaries.describe(B.contracts(spark, sf), "n_chars").withColumn("std", F.round("std", 6))


@query("agg_length_summary", with_sql("""SELECT round(avg(n), 1) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest, CAST(sum(n) AS BIGINT) AS total,
CAST(sum(CASE WHEN n > 512 THEN 1 ELSE 0 END) AS BIGINT) AS over_limit, round(100 * sum(CASE WHEN n > 512 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 2) AS over_limit_pct, CAST(sum(CASE WHEN n > 512 THEN p ELSE 0 END) AS BIGINT) AS positives_over_limit
FROM (SELECT CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n, doc_id % 4 AS p FROM contracts)""", "contracts"))  # fmt: skip
def agg_length_summary(spark, sf):
    rows = B.contracts(spark, sf).select(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).cast("long").alias("n_tokens"), (F.col("doc_id") % 4).alias("positives"))
    return summaries.length_summary(rows, 512).withColumn("p95", F.round("p95", 6)).withColumn("p99", F.round("p99", 6))


@query("agg_multiplicity", with_sql("SELECT category, count(*) AS contracts, max(n) AS most, avg(n) AS mean, 100 * sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS pct_multiple FROM (SELECT contract, category, count(*) AS n FROM (SELECT contract, category FROM spans UNION ALL SELECT contract, category FROM spans WHERE start % 3 = 0) GROUP BY ALL) GROUP BY category", "spans"))
def agg_multiplicity(spark, sf):
    spans = B.spans(spark, sf)
    return summaries.multiplicity(spans.unionByName(spans.where("start % 3 = 0")))


@query("agg_redaction", with_sql(rf"""SELECT category, count(*) AS n, CAST(sum(CAST(r AS INTEGER)) AS BIGINT) AS redacted, CAST(sum(CAST(s AS INTEGER)) AS BIGINT) AS short, 100 * sum(CAST(r AS INTEGER)) / CAST(count(*) AS DOUBLE) AS pct_redacted, 100 * sum(CAST(s AS INTEGER)) / CAST(count(*) AS DOUBLE) AS pct_short
FROM (SELECT category, regexp_matches(text, '\[\s*\*+\s*\]') AS r, length(text) < {SHORT_SPAN} AS s FROM spans) GROUP BY category""", "spans"))  # fmt: skip
def agg_redaction(spark, sf):
    return summaries.flag_rates(tables.quality_flags(B.spans(spark, sf), clean=False))


@query("agg_missing_hist", with_sql("SELECT missing, count(*) AS contracts FROM (SELECT contract, CAST(sum(CAST(NOT has_clause AS INTEGER)) AS BIGINT) AS missing FROM grid GROUP BY contract) GROUP BY missing", "spans", more=_GRID))
def agg_missing_hist(spark, sf):
    return summaries.missing_histogram(_grid(spark, sf))


@query("agg_split_summary", with_sql("SELECT * FROM (SELECT split, count(*) AS contracts, median(n_chars) AS median_chars, max(n_chars) AS max_chars FROM contracts GROUP BY split) LEFT JOIN (SELECT split, count(*) AS spans, count(DISTINCT category) AS categories FROM spans GROUP BY split) USING (split)", "spans"))
def agg_split_summary(spark, sf):
    return summaries.split_summary(B.contracts(spark, sf), B.spans(spark, sf))


@query("agg_dedup_spans", with_sql('SELECT DISTINCT contract, category, start, "end" FROM spans', "spans"))
def agg_dedup_spans(spark, sf):
    spans = B.spans(spark, sf).select("contract", "category", "start", "end")
    return tables.distinct_spans(spans.unionByName(spans.where("start % 2 = 0")))


@query("agg_leakage_prefix", with_sql("SELECT contract, split, n_chars FROM contracts WHERE substring(text, 1, 3000) IN (SELECT substring(text, 1, 3000) FROM contracts GROUP BY 1 HAVING count(*) > 1)", "contracts"))
def agg_leakage_prefix(spark, sf):
    return tables.shared_openings(B.contracts(spark, sf))


@query("agg_leakage_cross_split", with_sql("SELECT sha256(substring(text, 1, 3000)) AS sig, count(*) AS n_contracts FROM contracts GROUP BY 1 HAVING count(DISTINCT split) > 1", "contracts"))
def agg_leakage_cross_split(spark, sf):
    return tables.crossing_openings(B.contracts(spark, sf))


@query("agg_pivot_presence", with_sql("SELECT contract, " + ", ".join(f"max(CASE WHEN category = '{c}' THEN CAST(has_clause AS INTEGER) ELSE 0 END) AS {c.lower().replace(' ', '_').replace('-', '_')}" for c in CATEGORIES) + " FROM grid GROUP BY contract", "spans", more=_GRID))
def agg_pivot_presence(spark, sf):
    return summaries.presence_pivot(_grid(spark, sf), CATEGORIES)


_POOLED = "pooled AS (SELECT contract, doc_id, category, category_idx, max(score) AS score, max(label) AS label, TRUE AS mask FROM scored GROUP BY ALL)"


@query("agg_pool_contract_max", with_sql("SELECT contract, category, score, label FROM pooled", "scored", more=_POOLED))
def agg_pool_contract_max(spark, sf):
    return metrics.pool_contracts(B.scored(spark, sf)).select("contract", "category", "score", "label")


@query("agg_positive_weights", with_sql("SELECT category, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, sum(1 - label) / CAST(sum(label) AS DOUBLE) AS weight FROM scored WHERE mask GROUP BY category", "scored"))
def agg_positive_weights(spark, sf):
    return metrics.positive_weights(B.scored(spark, sf))


@query("agg_fold_counts", with_sql("SELECT fold, count(*) AS n FROM (SELECT DISTINCT contract, fold FROM scored) GROUP BY fold", "scored"))
def agg_fold_counts(spark, sf):
    return B.scored(spark, sf).select("contract", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n"))


@query("agg_distinct_contracts", with_sql("SELECT count(DISTINCT contract) AS contracts, count(DISTINCT category) AS categories FROM spans", "spans"))
def agg_distinct_contracts(spark, sf):
    return B.spans(spark, sf).agg(F.countDistinct("contract").alias("contracts"), F.countDistinct("category").alias("categories"))


@query("agg_token_totals", with_sql(r"SELECT sum(a) / CAST(sum(b) AS DOUBLE) AS ratio FROM (SELECT len(regexp_extract_all(text, '\w+')) AS a, len(regexp_extract_all(text, '\S+')) AS b FROM conversations)"))
def agg_token_totals(spark, sf):
    n = lambda p: F.sum(F.size(F.regexp_extract_all("text", F.lit(p), 1)))
    return table(spark, sf, "conversations").agg((n(r"([0-9A-Za-z_]+)") / n(r"(\S+)")).alias("ratio"))


# Windows, sorts, sets -------------------------------------------------------

_AP = f"""curve AS (SELECT category, score, sum(label) AS tp, count(*) AS n FROM scored WHERE mask GROUP BY ALL),
cum AS (SELECT *, sum(tp) OVER w AS cum_tp, sum(n) OVER w AS cum_n FROM curve WINDOW w AS (PARTITION BY category ORDER BY score DESC)),
ap AS (SELECT category, CASE WHEN sum(tp) > 0 THEN CAST(sum(tp * {_fixed('cum_tp / CAST(cum_n AS DOUBLE)')}) AS DOUBLE) / CAST(sum(tp) * {metrics.SCALE} AS DOUBLE) END AS average_precision FROM cum GROUP BY category)"""


@query("win_average_precision", with_sql("SELECT * FROM ap", "scored", more=_AP))
def win_average_precision(spark, sf):
    return metrics.average_precision(B.scored(spark, sf))


@query("win_pr_curve", with_sql("SELECT DISTINCT category, cum_tp / CAST(p AS DOUBLE) AS recall, cum_tp / CAST(cum_n AS DOUBLE) AS precision FROM cum JOIN (SELECT category, sum(tp) AS p FROM curve GROUP BY category HAVING sum(tp) > 0) USING (category) UNION SELECT category, 0.0::DOUBLE, 1.0::DOUBLE FROM curve GROUP BY category HAVING sum(tp) > 0", "scored", more=_AP))
def win_pr_curve(spark, sf):
    return metrics.pr_curve(B.scored(spark, sf))


@query("win_chunk_gaps", with_sql("""SELECT chunk_id, start - lag(start) OVER w AS step, max("end") OVER (PARTITION BY contract ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - start AS overlap FROM windows WINDOW w AS (PARTITION BY contract ORDER BY start, "end")""", "windows"))
def win_chunk_gaps(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("contract").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return B.windows(spark, sf).select("chunk_id", (F.col("start") - F.lag("start").over(order)).alias("step"), (reach - F.col("start")).alias("overlap"))


@query("win_quantile_sample", with_sql("SELECT place AS rank, contract, n_chars FROM (SELECT contract, n_chars, row_number() OVER (ORDER BY n_chars, contract) - 1 AS place, count(*) OVER () AS n FROM contracts) WHERE place IN (CAST(round_even((n - 1) * 0.1, 0) AS BIGINT), CAST(round_even((n - 1) * 0.5, 0) AS BIGINT), CAST(round_even((n - 1) * 0.9, 0) AS BIGINT))", "contracts"))
def win_quantile_sample(spark, sf):
    return summaries.quantile_sample(B.contracts(spark, sf))


@query("sort_topk_longest", with_sql("SELECT contract, n_chars FROM contracts ORDER BY n_chars DESC, contract LIMIT 20", "contracts"))
def sort_topk_longest(spark, sf):
    return B.contracts(spark, sf).select("contract", "n_chars").orderBy(F.desc("n_chars"), "contract").limit(20)


@query("sort_category_order", with_sql("SELECT category, category_idx, count(s.contract) AS n FROM cats LEFT JOIN spans s USING (category) GROUP BY ALL ORDER BY category_idx", "spans"))
def sort_category_order(spark, sf):
    order = spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, category_idx int")
    counts = B.spans(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return order.join(counts, "category", "left").fillna(0, ["n"]).orderBy("category_idx")


@query("set_union_splits", with_sql("SELECT contract, split FROM contracts", "contracts"))
def set_union_splits(spark, sf):
    c = B.contracts(spark, sf).select("contract", "split")
    return c.where("split = 'train'").unionByName(c.where("split = 'test'"))


@query("set_leak_intersect", with_sql("SELECT sha256(text) AS sha FROM contracts WHERE split = 'train' INTERSECT SELECT sha256(text) FROM contracts WHERE split = 'test'", "contracts"))
def set_leak_intersect(spark, sf):
    c = B.contracts(spark, sf).select("split", F.sha2("text", 256).alias("sha"))
    return c.where("split = 'train'").select("sha").intersect(c.where("split = 'test'").select("sha"))


@query("set_category_difference", with_sql("SELECT category FROM cats EXCEPT SELECT category FROM spans WHERE split = 'test' AND start < 40", "spans"))
def set_category_difference(spark, sf):
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.subtract(B.spans(spark, sf).where("split = 'test' and start < 40").select("category"))


@query("set_round_trip", with_sql("SELECT 0::BIGINT AS differences", "contracts"))
def set_round_trip(spark, sf):
    a = B.spans(spark, sf).select("contract", "category", "start")
    return a.exceptAll(a.repartition(3)).unionByName(a.repartition(3).exceptAll(a)).agg(F.count("*").alias("differences"))


# Windows of text, labels ----------------------------------------------------


@query("chunk_fixed_chars", with_sql('SELECT contract, start, "end", sha256(text) AS sha FROM windows', "windows"))
def chunk_fixed_chars(spark, sf):
    rows = chunking.fixed_windows(B.contracts(spark, sf), B.WINDOW_CHARS, B.STRIDE_CHARS)
    return rows.select("contract", "start", "end", F.sha2("text", 256).alias("sha"))


@query("chunk_fixed_words", with_sql(r"""SELECT contract, CAST(first_word // 40 AS BIGINT) AS "window", first_word, least(50, len(w) - first_word) AS n_words, array_to_string(w[first_word + 1 : first_word + 50], ' ') AS text
FROM (SELECT contract, w, unnest(range(0, greatest(len(w) - 10, 1), 40)) AS first_word FROM (SELECT contract, regexp_extract_all(text, '\S+') AS w FROM contracts) WHERE len(w) > 0)""", "contracts"))  # fmt: skip
def chunk_fixed_words(spark, sf):
    return chunking.fixed_words(B.contracts(spark, sf), 50, 10)


@query("chunk_paragraph_only", with_sql(r"""SELECT contract, start, start + n AS "end", text FROM (SELECT contract, p AS text, CAST(length(p) AS BIGINT) AS n, CAST(coalesce(sum(length(p)) OVER (PARTITION BY contract ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT contract, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT contract, regexp_extract_all(text, '[\s\S]+?(?:\n[ \t]*\n+|\z)') AS ps FROM contracts))) WHERE NOT regexp_matches(text, '^\s*$')""", "contracts"))
def chunk_paragraph_only(spark, sf):
    return chunking.paragraphs(B.contracts(spark, sf))


@query("chunk_hybrid_words")
def chunk_hybrid_words(spark, sf):
    return chunking.chunk_contracts(B.contracts(spark, sf), "words", chunking.Config(120, 30), reasons=True)


@query("chunk_byte_bpe")
def chunk_byte_bpe(spark, sf):
    import public_tokenizers

    return chunking.chunk_contracts(B.contracts(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def _compared(spark, sf, told):
    windows, _ = spill(spark, chunking.strategy_windows(B.contracts(spark, sf), told, "words", 120))
    return chunking.compare_strategies(windows, B.spans(spark, sf), 120)


@query("chunk_strategy_compare")
def chunk_strategy_compare(spark, sf):
    return _compared(spark, sf, chunking.strategies((0, 16, 30, 60), 120))["summary"]


@query("chunk_strategy_reasons")
def chunk_strategy_reasons(spark, sf):
    return _compared(spark, sf, chunking.strategies((0, 16, 30, 60), 120))["reasons"]


_FIXED = tuple(s for s in chunking.strategies((0, 30), 120) if not s.natural)
_CUT = r"""pieces AS (SELECT contract, n_chars, regexp_extract_all(text, '\S+') AS ws, regexp_extract_all(text, '\s+') AS ss, CASE WHEN regexp_matches(text, '^\s') THEN 1 ELSE 0 END AS lead FROM contracts),
tokens AS (SELECT contract, k, CAST(coalesce(sum(size) OVER (PARTITION BY contract ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + first AS BIGINT) AS at FROM (SELECT contract, k, CASE WHEN lead = 1 THEN length(ss[1]) ELSE 0 END AS first, length(ws[k]) + coalesce(length(ss[k + lead]), 0) AS size FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM pieces))),"""


def _fixed_sql() -> str:
    parts = [f"SELECT '{s.name}' AS strategy, contract, n_chars, len(ws) AS n, j * (120 - {s.overlap}) AS f FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((len(ws) - 120) / (120.0 - {s.overlap})) AS BIGINT), 0) + 1)) AS j FROM pieces WHERE len(ws) > 0)" for s in _FIXED if s.overlap is not None]
    return _CUT + "\nfixed AS (" + " UNION ALL ".join(parts) + r"""),
cut AS (SELECT strategy, fixed.contract, n AS n_source, CASE WHEN f = 0 THEN 0 ELSE a.at END AS start, coalesce(b.at, n_chars) AS "end", least(120, n - f) AS n_tokens FROM fixed LEFT JOIN tokens a ON a.contract = fixed.contract AND a.k = f + 1 LEFT JOIN tokens b ON b.contract = fixed.contract AND b.k = f + 121
UNION ALL SELECT 'paragraph_only', contract, n, start, start + length(p), len(regexp_extract_all(p, '\S+')) FROM (SELECT contract, n, p, CAST(coalesce(sum(length(p)) OVER (PARTITION BY contract ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT contract, len(ws) AS n, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT c.contract, ws, regexp_extract_all(text, '[\s\S]+?(?:\n[ \t]*\n+|\z)') AS ps FROM contracts c JOIN pieces USING (contract)))) WHERE NOT regexp_matches(p, '^\s*$')),
own AS (SELECT DISTINCT contract, category, start AS s, "end" AS e FROM spans),
pairs AS (SELECT c.strategy, c.contract, c.start, c.n_tokens, o.category, s, e, c.start <= s AND e <= c."end" AS full_ FROM cut c JOIN own o ON o.contract = c.contract AND c.start < e AND s < c."end"),
touched AS (SELECT strategy, count(*) AS touched, sum(CASE WHEN partial THEN 1 ELSE 0 END) AS partial_only FROM (SELECT strategy, contract, start, bool_or(NOT f) AS partial FROM (SELECT strategy, contract, start, category, bool_or(full_) AS f FROM pairs GROUP BY ALL) GROUP BY strategy, contract, start) GROUP BY strategy),
held AS (SELECT strategy, count(*) AS any_size, sum(CASE WHEN w THEN 1 ELSE 0 END) AS within FROM (SELECT strategy, contract, category, s, e, bool_or(n_tokens <= 120) AS w FROM pairs WHERE full_ GROUP BY ALL) GROUP BY strategy),
fresh AS (SELECT *, greatest("end" - greatest(start, coalesce(max("end") OVER (PARTITION BY strategy, contract ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS new_ FROM cut)"""


@query("chunk_strategy_fixed", with_sql("""SELECT strategy, count(*) AS chunks, CAST(sum(CASE WHEN n_tokens > 120 THEN 1 ELSE 0 END) AS BIGINT) AS over_budget, CAST(sum(n_tokens) AS BIGINT) AS tokens, max(n_tokens) AS max_tokens, CAST(sum(new_) AS BIGINT) AS covered_chars, CAST(any_value(any_size) AS BIGINT) AS contained_any_size, CAST(any_value(within) AS BIGINT) AS contained_within_budget, (SELECT count(*) FROM own) AS spans, CAST(count(*) - any_value(touched) AS BIGINT) AS no_overlap, CAST(any_value(partial_only) AS BIGINT) AS partial_only, sum(n_tokens) / (SELECT CAST(sum(len(ws)) AS DOUBLE) FROM pieces) AS work_multiplier
FROM fresh JOIN touched USING (strategy) JOIN held USING (strategy) GROUP BY strategy""", "spans", more=_fixed_sql()))
def chunk_strategy_fixed(spark, sf):
    """The strategies whose windows SQL can place."""
    return _compared(spark, sf, _FIXED)["summary"]


@query("label_chunks_long", with_sql("SELECT contract, chunk_id, category, label, mask FROM labeled", "labeled"))
def label_chunks_long(spark, sf):
    return labeling.label_windows(B.windows(spark, sf), B.spans(spark, sf)).select("contract", "chunk_id", "category", "label", "mask")


@query("label_arrays", with_sql("SELECT chunk_id, string_agg(CAST(label AS VARCHAR), '' ORDER BY category_idx) AS labels, string_agg(CASE WHEN mask THEN 't' ELSE 'f' END, '' ORDER BY category_idx) AS label_mask FROM labeled GROUP BY chunk_id", "labeled"))
def label_arrays(spark, sf):
    rows = labeling.as_arrays(labeling.label_windows(B.windows(spark, sf), B.spans(spark, sf)))
    return rows.select("chunk_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"), F.array_join(F.transform("label_mask", lambda x: F.when(x, "t").otherwise("f")), "").alias("label_mask"))


@query("label_report", with_sql(f"""SELECT 'chunks' AS name, count(*) AS value FROM windows UNION ALL SELECT 'spans', count(*) FROM spans UNION ALL SELECT 'duplicate_spans', count(*) - (SELECT count(*) FROM d) FROM spans
UNION ALL SELECT 'contained_spans', count(*) FROM d s WHERE {_HELD} UNION ALL SELECT 'uncovered_spans', count(*) FROM d s WHERE NOT {_HELD}
UNION ALL SELECT 'no_overlap', count(*) FROM windows WHERE chunk_id NOT IN (SELECT chunk_id FROM evidence) UNION ALL SELECT 'partial_only', count(*) FROM (SELECT chunk_id FROM evidence GROUP BY chunk_id HAVING NOT bool_or(fully_contained))
UNION ALL SELECT 'multi_label', count(*) FROM (SELECT chunk_id FROM labeled GROUP BY chunk_id HAVING sum(label) > 1) UNION ALL SELECT 'positive_pairs', count(*) FROM labeled WHERE label = 1 UNION ALL SELECT 'masked_pairs', count(*) FROM labeled WHERE NOT mask UNION ALL SELECT 'evidence', count(*) FROM evidence""", "labeled", more='d AS (SELECT DISTINCT contract, category, start, "end" FROM spans)'))  # fmt: skip
def label_report(spark, sf):
    windows, spans = B.windows(spark, sf), B.spans(spark, sf)
    found = labeling.evidence(windows, spans)
    return labeling.report(labeling.labels_of(windows, found), found, windows, spans)


# Rules ----------------------------------------------------------------------


# All shipped rules but the one that looks behind, which DuckDB's patterns can't say; it has a query of its own.
_SAID = tuple(r for r in rules.RULES if "(?<!" not in r.pattern)


def _rule_sql(pattern: str) -> str:
    return "(?i)" + pattern.replace(" ", r"\s+").replace("'", "''")


_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{r.category}' AS category, '{r.name}' AS rule, regexp_matches(text, '{_rule_sql(r.pattern)}') AS hit FROM clauses" for r in _SAID) + ")"


@query("rule_hits", with_sql("SELECT chunk_id, category, rule FROM hits WHERE hit", "clauses", more=_HITS))
def rule_hits(spark, sf):
    return rules.rule_hits(B.clauses(spark, sf).select("chunk_id", "text"), _SAID, fired=True).select("chunk_id", "category", "rule")


@query("rule_table", with_sql("SELECT r.category, r.rule, length(r.rationale) AS said, count(h.rule) AS fired FROM " + _values([(r.category, r.name, r.rationale) for r in _SAID], "category, rule, rationale").replace("AS t(", "AS r(") + " LEFT JOIN (SELECT * FROM hits WHERE hit) h USING (category, rule) GROUP BY ALL", "clauses", more=_HITS))
def rule_table(spark, sf):
    """Every shipped rule that SQL can say, with how many windows it fires in."""
    fired = rules.rule_hits(B.clauses(spark, sf).select("chunk_id", "text"), _SAID, fired=True).groupBy("category", "rule").agg(F.count("*").alias("fired"))
    told = rules.rule_table(spark, _SAID).select("category", "rule", F.length("rationale").cast("long").alias("said"))
    return told.join(fired, ["category", "rule"], "left").fillna(0, ["fired"])


@query("rule_hits_exclusive")
def rule_hits_exclusive(spark, sf):
    only = tuple(r for r in rules.RULES if r not in _SAID)
    return rules.rule_hits(B.clauses(spark, sf).select("chunk_id", "text"), only, fired=True).select("chunk_id", "category", "rule")


@query("rule_category_scores", with_sql("SELECT chunk_id, category, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS n_rules FROM hits GROUP BY ALL HAVING bool_or(hit)", "clauses", more=_HITS))
def rule_category_scores(spark, sf):
    return rules.category_scores(B.clauses(spark, sf).select("chunk_id", "text"), _SAID).where("n_rules > 0").select("chunk_id", "category", "n_rules")


@query("rule_explain", with_sql("SELECT chunk_id, category, rule, CAST(length(m.before) AS BIGINT) AS start, CAST(length(m.before) + length(m.found) AS BIGINT) AS \"end\", m.found AS match FROM (" + " UNION ALL ".join(f"SELECT chunk_id, '{r.category}' AS category, '{r.name}' AS rule, regexp_extract(text, '(?i)^([\\s\\S]*?)({_rule_sql(r.pattern).removeprefix('(?i)')})', ['before', 'found']) AS m FROM clauses" for r in _SAID) + ") WHERE m.found <> ''", "clauses"))
def rule_explain(spark, sf):
    return rules.explain(B.clauses(spark, sf).select("chunk_id", "text"), _SAID).select("chunk_id", "category", "rule", "start", "end", "match")


_PROSE = (rules.Rule("Governing Law", "the_of", r"\bthe of\b"), rules.Rule("Governing Law", "ing_end", r"ing\."), rules.Rule("Audit Rights", "license", r"\blicense\b"), rules.Rule("Audit Rights", "that_near_with", rules.near(r"\bthat\b", r"\bwith\b", 40)))


@query("rule_hits_prose", with_sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT chunk_id, '{r.category}' AS category, '{r.name}' AS rule, regexp_matches(text, '{_rule_sql(r.pattern)}') AS hit FROM windows" for r in _PROSE) + ") WHERE hit", "windows"))
def rule_hits_prose(spark, sf):
    return rules.rule_hits(B.windows(spark, sf).select("chunk_id", "text"), _PROSE).where("hit")


def _labeled_clauses(spark, sf):
    windows = B.clauses(spark, sf)
    return labeling.label_windows(windows.select("contract", "chunk_id", "start", "end"), B.spans(spark, sf)), windows


@query("rule_stats", with_sql("""SELECT r.category, r.rule, CAST(coalesce(fired, 0) AS BIGINT) AS fired, CAST(coalesce(tp, 0) AS BIGINT) AS true_positive, CASE WHEN fired > 0 THEN tp / CAST(fired AS DOUBLE) END AS precision, CASE WHEN positives > 0 THEN coalesce(tp, 0) / CAST(positives AS DOUBLE) END AS recall, CAST(coalesce(o, 0) AS BIGINT) AS only_rule_fired, CAST(coalesce(otp, 0) AS BIGINT) AS only_rule_true_positive
FROM (SELECT DISTINCT category, rule FROM hits) r LEFT JOIN (SELECT h.category, h.rule, count(*) AS fired, sum(label) AS tp, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS o, sum(CASE WHEN n = 1 THEN label ELSE 0 END) AS otp
FROM hits h JOIN (SELECT chunk_id, category, sum(CAST(hit AS INTEGER)) AS n FROM hits GROUP BY ALL) a USING (chunk_id, category) JOIN labeled l ON l.chunk_id = h.chunk_id AND l.category = h.category AND l.mask WHERE h.hit GROUP BY ALL) f ON f.category = r.category AND f.rule = r.rule
LEFT JOIN (SELECT category, sum(label) AS positives FROM labeled WHERE mask GROUP BY category) p ON p.category = r.category""", "labeled", "clauses", more=_HITS))  # fmt: skip
def rule_stats(spark, sf):
    labeled, windows = _labeled_clauses(spark, sf)
    every = rules.rule_table(spark, _SAID).select("category", "rule").join(windows.limit(1).select(F.lit(1)), F.lit(True), "left_semi")
    return rules.rule_stats(labeled, rules.rule_hits(windows.select("chunk_id", "text"), _SAID, fired=True), every)


# Metrics --------------------------------------------------------------------


def _score_sql(threshold: str, decided: str = "CASE WHEN score >= {t} THEN 1 ELSE 0 END", ap: str = "average_precision") -> str:
    d = decided.format(t=threshold)
    rate = lambda a, b: f"CASE WHEN scored_chunks > 0 THEN CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / CAST({b} AS DOUBLE) END END"
    rates = f"{rate('tp', 'predicted_positive')} AS precision, {rate('tp', 'support')} AS recall, {rate('2 * tp', '(predicted_positive + support)')} AS f1"
    mean = lambda c: f"CAST(sum({_fixed(c)}) AS DOUBLE) / CAST(count({c}) * {metrics.SCALE} AS DOUBLE)"
    return f"""dec AS (SELECT *, {d} AS decision FROM scored),
sums AS (SELECT category, CAST(sum(CASE WHEN mask AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS support, CAST(sum(CASE WHEN mask THEN 1 ELSE 0 END) AS BIGINT) AS scored_chunks, CAST(sum(CASE WHEN NOT mask THEN 1 ELSE 0 END) AS BIGINT) AS masked_chunks,
CAST(sum(CASE WHEN mask AND decision = 1 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_positive, CAST(sum(CASE WHEN mask AND decision = 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM dec GROUP BY category),
byc AS (SELECT category, {threshold} AS threshold, support, scored_chunks, masked_chunks, predicted_positive, {rates}, {ap} FROM sums LEFT JOIN ap USING (category)),
pool AS (SELECT CAST(sum(support) AS BIGINT) AS support, CAST(sum(scored_chunks) AS BIGINT) AS scored_chunks, CAST(sum(masked_chunks) AS BIGINT) AS masked_chunks, CAST(sum(predicted_positive) AS BIGINT) AS predicted_positive, CAST(sum(tp) AS BIGINT) AS tp FROM sums),
one AS (SELECT CASE WHEN min(threshold) = max(threshold) THEN min(threshold) END AS threshold FROM byc),
metric AS (SELECT * FROM byc UNION ALL SELECT 'macro avg', (SELECT threshold FROM one), CAST(sum(support) AS BIGINT), CAST(sum(scored_chunks) AS BIGINT), CAST(sum(masked_chunks) AS BIGINT), CAST(sum(predicted_positive) AS BIGINT), {mean('precision')}, {mean('recall')}, {mean('f1')}, {mean('average_precision')} FROM byc
UNION ALL SELECT 'micro avg', (SELECT threshold FROM one), support, scored_chunks, masked_chunks, predicted_positive, {rates}, NULL FROM pool)"""


@query("metric_score", with_sql("SELECT * FROM metric", "scored", more=_AP + ",\n" + _score_sql("0.5::DOUBLE")))
def metric_score(spark, sf):
    return metrics.score(B.scored(spark, sf))


@query("rule_evaluate", with_sql("SELECT category, support, predicted_positive, precision, recall, f1, average_precision FROM metric", "labeled", "clauses", more=_HITS + ",\nfired AS (SELECT chunk_id, category, sum(CAST(hit AS INTEGER)) AS n FROM hits GROUP BY ALL),\nscored AS (SELECT l.*, CAST(coalesce(n, 0) AS DOUBLE) AS score FROM labeled l LEFT JOIN fired USING (chunk_id, category)),\n" + _AP + ",\n" + _score_sql("NULL::DOUBLE", "CASE WHEN score >= 1 THEN 1 ELSE 0 END")))
def rule_evaluate(spark, sf):
    labeled, windows = _labeled_clauses(spark, sf)
    return rules.evaluate(labeled, windows, _SAID)[0].select("category", "support", "predicted_positive", "precision", "recall", "f1", "average_precision")


_TUNED_CASE = "(CASE category WHEN 'Governing Law' THEN 0.3 WHEN 'Audit Rights' THEN 0.9 ELSE 0.5 END)::DOUBLE"


@query("metric_score_tuned", with_sql("SELECT * FROM metric", "scored", more=_AP + ",\n" + _score_sql(_TUNED_CASE)))
def metric_score_tuned(spark, sf):
    return metrics.score(B.scored(spark, sf), dict.fromkeys(CATEGORIES, 0.5) | {"Governing Law": 0.3, "Audit Rights": 0.9})


def _grid_sql(grid) -> str:
    return "(SELECT unnest([" + ", ".join(f"{g!r}::DOUBLE" for g in grid) + "]) AS t)"


def _tune_sql(rows: str, grid, keys: str = "category", out: str = "tuned") -> str:
    """``rows`` has the keys, label, mask, score."""
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / CAST({b} AS DOUBLE) END"
    return f"""{out}_c AS (SELECT {keys}, score, count(*) AS n, sum(label) AS tp FROM {rows} WHERE mask GROUP BY ALL),
{out}_g AS (SELECT {keys}, t, sum(CASE WHEN score >= t THEN tp ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN n ELSE 0 END) AS pp, sum(tp) AS p, sum(CASE WHEN score >= 0.5 THEN tp ELSE 0 END) AS dtp, sum(CASE WHEN score >= 0.5 THEN n ELSE 0 END) AS dpp FROM {out}_c CROSS JOIN {_grid_sql(grid)} GROUP BY ALL),
{out}_b AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {r('2 * tp', '(pp + p)')} DESC, t) AS place FROM {out}_g),
{out} AS (SELECT {keys}, CASE WHEN p > 0 THEN t ELSE 0.5 END AS threshold, CAST(p AS BIGINT) AS support, CASE WHEN p > 0 THEN {r('2 * tp', '(pp + p)')} END AS f1, CASE WHEN p > 0 THEN {r('tp', 'pp')} END AS precision, CASE WHEN p > 0 THEN {r('tp', 'p')} END AS recall, 0.5::DOUBLE AS default_threshold, CASE WHEN p > 0 THEN {r('2 * dtp', '(dpp + p)')} END AS default_f1, CASE WHEN p > 0 THEN {r('2 * tp', '(pp + p)')} - {r('2 * dtp', '(dpp + p)')} END AS f1_gain FROM {out}_b WHERE place = 1)"""


_HELD_OUT = "others AS (SELECT h.fold AS held, s.* EXCLUDE (fold) FROM scored s JOIN (SELECT DISTINCT fold FROM scored) h ON h.fold <> s.fold)"


@query("metric_tune_thresholds", with_sql("SELECT * FROM tuned", "scored", more=_tune_sql("scored", TUNING_GRID)))
def metric_tune_thresholds(spark, sf):
    return metrics.tune_thresholds(B.scored(spark, sf))


@query("metric_cross_fit", with_sql("SELECT held AS fold, * EXCLUDE (held) FROM tuned", "scored", more=_HELD_OUT + ",\n" + _tune_sql("others", FINE_GRID, "held, category")))
def metric_cross_fit(spark, sf):
    return metrics.cross_fit_thresholds(B.scored(spark, sf))


@query("metric_cross_fit_decisions", with_sql("SELECT s.fold, s.category, CAST(sum(CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM scored s JOIN tuned t ON t.held = s.fold AND t.category = s.category GROUP BY ALL", "scored", more=_HELD_OUT + ",\n" + _tune_sql("others", FINE_GRID, "held, category")))
def metric_cross_fit_decisions(spark, sf):
    return metrics.cross_fit_decisions(B.scored(spark, sf)).groupBy("fold", "category").agg(F.sum("decision").cast("long").alias("positives"))


@query("metric_score_decisions", with_sql("SELECT category, support, predicted_positive, precision, recall, f1, average_precision FROM metric", "scored", more=_AP + ",\n" + _score_sql("NULL::DOUBLE", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END")))
def metric_score_decisions(spark, sf):
    decided = B.scored(spark, sf).withColumn("decision", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return metrics.score_given(decided).select("category", "support", "predicted_positive", "precision", "recall", "f1", "average_precision")


@query("metric_final_thresholds", with_sql("""SELECT t.*, lo AS fold_threshold_min, hi AS fold_threshold_max, round(sd, 9) AS fold_threshold_std, concat_ws('; ', CASE WHEN sd > 0.10 THEN 'unstable threshold' END, CASE WHEN support < 200 THEN 'low support' END) AS flag
FROM tuned t JOIN (SELECT category, min(threshold) AS lo, max(threshold) AS hi, stddev_samp(threshold) AS sd FROM held_t GROUP BY category) USING (category)""", "scored", more=_HELD_OUT + ",\n" + _tune_sql("others", TUNING_GRID, "held, category", "held_t") + ",\n" + _tune_sql("scored", TUNING_GRID)))  # fmt: skip
def metric_final_thresholds(spark, sf):
    return metrics.final_thresholds(B.scored(spark, sf)).withColumn("fold_threshold_std", F.round("fold_threshold_std", 9))


_LOGIT = "ln((score + 0.0005) / (1.0005 - score))"
_BCE = f"((1 - label) * {_LOGIT} + (1 + ({{w}} - 1) * label) * (ln(1 + exp(-abs({_LOGIT}))) + greatest(-({_LOGIT}), 0.0)))"


def _logits(spark, sf):
    return B.scored(spark, sf).withColumn("logit", F.log((F.col("score") + 0.0005) / (1.0005 - F.col("score"))))


@query("metric_masked_bce", with_sql(f"SELECT category, round(avg({_BCE.format(w=2)}), 8) AS loss FROM scored WHERE mask GROUP BY category", "scored"))
def metric_masked_bce(spark, sf):
    return metrics.masked_bce(_logits(spark, sf), dict.fromkeys(CATEGORIES, 2.0), "category").select("category", F.round("loss", 8).alias("loss"))


@query("metric_focal", with_sql(f"SELECT category, round(avg((CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - exp(-{_BCE.format(w=1)}), 2) * {_BCE.format(w=1)}), 8) AS loss FROM scored WHERE mask GROUP BY category", "scored"))
def metric_focal(spark, sf):
    return metrics.masked_focal(_logits(spark, sf), 2.0, 0.25, "category").select("category", F.round("loss", 8).alias("loss"))


@query("metric_weighted_loss", "SELECT round(sum(quality * (toxic + 1)) / CAST(sum(toxic + 1) AS DOUBLE), 9) AS loss, round(sum(1 / (1 + exp(-CAST(quality AS DOUBLE)))) / count(*), 9) AS sigmoid FROM labels")
def metric_weighted_loss(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("loss"), (F.col("toxic") + 1).alias("valid"))
    return metrics.weighted_mean_loss(rows).select(F.round("loss", 9).alias("loss")).crossJoin(rows.agg(F.round(F.avg(metrics.sigmoid(F.col("loss"))), 9).alias("sigmoid")))


@query("metric_contract_report", with_sql("SELECT * FROM metric", "scored", more=_POOLED + ",\nscored_all AS (SELECT * FROM scored),\n" + (_AP + ",\n" + _score_sql("0.5::DOUBLE")).replace("FROM scored", "FROM pooled")))
def metric_contract_report(spark, sf):
    return metrics.score(metrics.pool_contracts(B.scored(spark, sf)))


# Folds, samples, bootstrap --------------------------------------------------

_FOLDS = """RECURSIVE sizes AS (SELECT CAST(conv_id AS VARCHAR) AS contract, count(*) AS chunks FROM conversations GROUP BY 1),
listed AS (SELECT list({'c': contract, 'n': chunks} ORDER BY chunks DESC, contract) AS l FROM sizes),
step AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS contract, NULL::BIGINT AS fold, NULL::BIGINT AS chunks
UNION ALL SELECT i + 1, list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN l[i + 1].n ELSE 0 END), l[i + 1].c, list_position(loads, list_min(loads)) - 1, l[i + 1].n FROM step, listed WHERE i < len(l))"""


@query("fold_assign", f"WITH {_FOLDS} SELECT contract, CAST(fold AS INTEGER) AS fold, chunks FROM step WHERE i > 0")
def fold_assign(spark, sf):
    return folds.contract_folds(scan_conversations(spark, sf).select("contract"), 5)


@query("fold_split", with_sql("SELECT category, count(*) AS n FROM scored WHERE fold <> 2 GROUP BY category", "scored"))
def fold_split(spark, sf):
    names = F.array(*(F.lit(c) for c in CATEGORIES))
    rows = B.wide(spark, sf).select("contract", "chunk_id", "fold", names.alias("categories"), F.lit("train").alias("split"))  # windows are split, then their categories counted
    dealt, _ = spill(spark, rows.select("contract", "fold").distinct())
    train, _ = folds.split_by_fold(rows.drop("fold"), dealt, 2)
    return train.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _draw_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query("sample_contracts", with_sql(f"SELECT contract FROM contracts ORDER BY {_draw_sql("concat_ws(':', '42', contract)")}, contract LIMIT 50", "contracts"))
def sample_contracts(spark, sf):
    return folds.select_contracts(B.contracts(spark, sf).select("contract"), 50)


@query("sample_downsample", with_sql(f"""SELECT chunk_id FROM w WHERE positive UNION ALL SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY {_draw_sql("concat_ws(':', '42000', chunk_id)")}, chunk_id) AS place FROM w WHERE NOT positive) WHERE place <= (SELECT 2 * count(*) FROM w WHERE positive)""", "labeled", more="w AS (SELECT chunk_id, max(label) = 1 AS positive FROM labeled GROUP BY chunk_id)"))
def sample_downsample(spark, sf):
    rows = B.scored(spark, sf).groupBy("chunk_id").agg((F.max("label") == 1).alias("positive"))
    return folds.downsample(rows).select("chunk_id")


@query("sample_length_fit", with_sql(r"SELECT chunk_id FROM windows WHERE greatest(len(regexp_extract_all(text, '\S+')), length(text) // 6) <= 60", "windows"))
def sample_length_fit(spark, sf):
    rows = B.windows(spark, sf).withColumn("len_words", F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).withColumn("len_chars", F.floor(F.length("text") / 6).cast("int"))
    return folds.fits_all(rows, ["len_words", "len_chars"], 60).select("chunk_id")


_ARMS = (("a", 0.5), ("b", 0.6), ("c", 0.75))
_SAMPLES = 2000


def _arms(spark, sf, arms=_ARMS):
    rows = metrics.pool_contracts(B.scored(spark, sf))
    decided = rows.select("contract", "category", "label", "mask", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), (F.col("score") >= t).cast("int").alias("decision")) for a, t in arms))).alias("x"))
    return decided.select("contract", "category", "label", "mask", "x.arm", "x.decision")


def _boot_sql(arms) -> str:
    return f"""arms(arm, t) AS (VALUES {', '.join(f"('{a}', {t})" for a, t in arms)}),
counts AS (SELECT arm, contract, category, sum(CASE WHEN score >= t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < t AND label = 1 THEN 1 ELSE 0 END) AS fn FROM pooled, arms WHERE mask GROUP BY ALL),
blocks AS (SELECT contract, b, md5('42:' || contract || ':' || b) AS h FROM (SELECT DISTINCT contract FROM counts), (SELECT unnest(range(0, {_SAMPLES // 4})) AS b)),
picks AS (SELECT contract, 4 * b + k AS sample, CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) AS u FROM blocks, (SELECT unnest([0, 1, 2, 3]) AS k)),
draws AS (SELECT sample, contract, {' + '.join(f"CAST(u >= {t} AS INTEGER)" for t in bootstrap.weight_bounds())} AS weight FROM picks UNION ALL SELECT -1, contract, 1 FROM (SELECT DISTINCT contract FROM counts)),
f AS (SELECT arm, sample, category, CASE WHEN sum(weight * (2 * tp + fp + fn)) = 0 THEN 0.0 ELSE sum(weight * 2 * tp) / CAST(sum(weight * (2 * tp + fp + fn)) AS DOUBLE) END AS f1 FROM counts JOIN draws USING (contract) GROUP BY ALL)"""


_BOOT = _boot_sql(_ARMS)
_WEAK = "category IN (" + ", ".join(f"'{c}'" for c in WEAK_CATEGORIES) + ")"


def _boot_mean(where: str = "TRUE") -> str:
    return f"CAST(sum(CASE WHEN {where} THEN {_fixed('f1')} END) AS DOUBLE) / CAST(sum(CASE WHEN {where} THEN 1 ELSE 0 END) * {metrics.SCALE} AS DOUBLE)"


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumn("ci_low", F.round("ci_low", 9)).withColumn("ci_high", F.round("ci_high", 9))


@query("boot_paired", with_sql("""SELECT a.arm AS arm_a, b.arm AS arm_b, a.metric, max(CASE WHEN sample < 0 THEN a.value - b.value END) AS difference, round(quantile_cont(CASE WHEN sample >= 0 THEN a.value - b.value END, 0.025), 9) AS ci_low, round(quantile_cont(CASE WHEN sample >= 0 THEN a.value - b.value END, 0.975), 9) AS ci_high
FROM long a JOIN long b USING (sample, metric) WHERE a.arm < b.arm GROUP BY ALL""", "scored", more=_POOLED + ",\n" + _BOOT + f",\nlong AS (SELECT arm, sample, 'macro_f1' AS metric, {_boot_mean()} AS value FROM f GROUP BY ALL UNION ALL SELECT arm, sample, 'weak_f1', {_boot_mean(_WEAK)} FROM f GROUP BY ALL)"))  # fmt: skip
def boot_paired(spark, sf):
    return _rounded(bootstrap.paired_bootstrap(_arms(spark, sf), _SAMPLES))


@query("boot_contract", with_sql("""SELECT 'b - a' AS comparison, category, round(quantile_cont(y.f1 - x.f1, 0.025), 9) AS ci_low, round(quantile_cont(y.f1 - x.f1, 0.975), 9) AS ci_high FROM (SELECT * FROM long WHERE arm = 'a') x JOIN (SELECT * FROM long WHERE arm = 'b') y USING (sample, category) GROUP BY category""", "scored", more=_POOLED + ",\n" + _BOOT + f",\nlong AS (SELECT arm, sample, category, f1 FROM f WHERE sample >= 0 UNION ALL SELECT arm, sample, 'macro avg', {_boot_mean()} FROM f WHERE sample >= 0 GROUP BY arm, sample)"))
def boot_contract(spark, sf):
    return _rounded(bootstrap.contract_intervals(_arms(spark, sf), "a", "b", _SAMPLES))


_LONG = f"long AS (SELECT arm, sample, 'macro_f1' AS metric, {_boot_mean()} AS value FROM f GROUP BY ALL UNION ALL SELECT arm, sample, 'weak_f1', {_boot_mean(_WEAK)} FROM f GROUP BY ALL)"
_CI = """ci AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.metric, quantile_cont(CASE WHEN sample >= 0 THEN a.value - b.value END, 0.025) AS lo, quantile_cont(CASE WHEN sample >= 0 THEN a.value - b.value END, 0.975) AS hi FROM long a JOIN long b USING (sample, metric) WHERE a.arm < b.arm GROUP BY ALL),
wins AS (SELECT arm_a AS winner, arm_b AS loser, metric FROM ci WHERE lo > 0 UNION ALL SELECT arm_b, arm_a, metric FROM ci WHERE hi < 0)"""
#: The arms with the thresholds that they decide by here.
_DECIDED = (("bce", 0.9), ("pos_weight", 0.5), ("focal", 0.55), ("downsample", 0.95))
_PLACES = "places(arm, place) AS (VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate((*bootstrap.FIXES, bootstrap.CONTROL))) + ")"


def _against(metric: str) -> str:
    return f"coalesce((SELECT max(1) FROM wins WHERE metric = '{metric}' AND winner = pick AND loser = '{bootstrap.CONTROL}'), (SELECT max(-1) FROM wins WHERE metric = '{metric}' AND loser = pick AND winner = '{bootstrap.CONTROL}'), 0) AS {metric}_against_control"


@query("decide_arm", with_sql(f"""SELECT pick, CASE WHEN n1 = 1 THEN 'macro_f1' WHEN n2 = 1 THEN 'weak_f1' ELSE 'simplicity' END AS decided_by, l1 AS macro_f1_leader, v1 AS macro_f1_level, l2 AS weak_f1_leader, v2 AS weak_f1_level, {_against('macro_f1')}, {_against('weak_f1')}
FROM (SELECT max(leader) AS l1, count(*) AS n1, string_agg(arm, ',' ORDER BY place) AS v1 FROM level1), (SELECT max(leader) AS l2, count(*) AS n2, string_agg(arm, ',' ORDER BY place) AS v2, arg_min(arm, place) AS pick FROM level2)""", "scored", more=_POOLED + ",\n" + _boot_sql(_DECIDED) + ",\n" + _LONG + ",\n" + _CI + ",\n" + _PLACES + f""",
now AS (SELECT arm, place, metric, value FROM long JOIN places USING (arm) WHERE sample < 0 AND arm <> '{bootstrap.CONTROL}'),
lead1 AS (SELECT arm AS leader FROM now WHERE metric = 'macro_f1' ORDER BY value DESC, place LIMIT 1),
level1 AS (SELECT DISTINCT arm, place, leader FROM now, lead1 WHERE NOT EXISTS (SELECT 1 FROM wins WHERE metric = 'macro_f1' AND winner = leader AND loser = arm)),
lead2 AS (SELECT n.arm AS leader FROM now n JOIN level1 USING (arm) WHERE metric = 'weak_f1' ORDER BY value DESC, n.place LIMIT 1),
level2 AS (SELECT arm, place, b.leader FROM level1 a, lead2 b WHERE NOT EXISTS (SELECT 1 FROM wins WHERE metric = 'weak_f1' AND winner = b.leader AND loser = arm))"""))  # fmt: skip
def decide_arm(spark, sf):
    decided = _arms(spark, sf, _DECIDED)
    pairs, _ = spill(spark, bootstrap.paired_bootstrap(decided, _SAMPLES))
    out = bootstrap.choose_arm(bootstrap.arm_means(decided), pairs)
    return out.select("pick", "decided_by", *(F.concat_ws(",", c).alias(c) if c.endswith("_level") else c for c in out.columns[2:]))


_CONFIGS = tuple((bootstrap.config_name(r, e), t) for r, e, t in ((2e-5, 1, 0.9), (2e-5, 2, 0.5), (2e-5, 3, 0.55), (3e-5, 2, 0.51)))
_CONFIG_VALUES = "configs(arm, learning_rate, epochs) AS (VALUES " + ", ".join(f"('{n}', {n.split('-ep')[0][2:]}::DOUBLE, {n.split('-ep')[1]})" for n, _ in _CONFIGS) + ")"


@query("decide_config", with_sql("SELECT arg_min(arm, (epochs, learning_rate, arm)) AS pick, arg_min(epochs, (epochs, learning_rate, arm)) AS epochs, arg_min(learning_rate, (epochs, learning_rate, arm)) AS learning_rate, count(*) AS tied FROM configs, (SELECT arm AS leader FROM long JOIN configs USING (arm) WHERE sample < 0 AND metric = 'macro_f1' ORDER BY value DESC, epochs, learning_rate LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM wins WHERE metric = 'macro_f1' AND winner = leader AND loser = arm)", "scored", more=_POOLED + ",\n" + _boot_sql(_CONFIGS) + ",\n" + _LONG + ",\n" + _CI + ",\n" + _CONFIG_VALUES))
def decide_config(spark, sf):
    decided = _arms(spark, sf, _CONFIGS)
    pairs, _ = spill(spark, bootstrap.paired_bootstrap(decided, _SAMPLES))
    named = bootstrap.parsed_config(F.col("arm"))
    summary = bootstrap.arm_means(decided).select(F.col("arm").alias("config"), "macro_f1", named["epochs"].alias("epochs"), named["learning_rate"].alias("learning_rate"))
    return bootstrap.select_config(summary, pairs)


def _sweep_sql(config: str, moved: float) -> str:
    """One macro row of a configuration whose scores are lower by ``moved``."""
    more = f"base AS (SELECT * REPLACE (greatest(score - {moved!r}, 0.0::DOUBLE) AS score) FROM scored_0),\nscored AS (SELECT * FROM base),\n" + _HELD_OUT + ",\n" + _tune_sql("others", FINE_GRID, "held, category") + ",\nthresholds AS (SELECT held, category AS c, threshold FROM tuned),\n" + _AP
    scored = _score_sql("NULL::DOUBLE", "CASE WHEN score >= (SELECT threshold FROM thresholds WHERE held = fold AND c = category) THEN 1 ELSE 0 END")
    inner = with_sql(f"SELECT '{config}' AS config, max(CASE WHEN category = 'macro avg' THEN f1 END) AS macro_f1, max(CASE WHEN category = 'micro avg' THEN f1 END) AS micro_f1, max(CASE WHEN category = 'macro avg' THEN average_precision END) AS macro_ap FROM metric", "scored", more=more + ",\n" + scored)
    return "(" + inner.replace("scored AS (SELECT *, least(", "scored_0 AS (SELECT *, least(", 1) + ")"


_SWEPT = ((bootstrap.config_name(2e-5, 1), 0.0), (bootstrap.config_name(2e-5, 2), 0.05))


@query("metric_sweep_table", " UNION ALL ".join(f"SELECT * FROM {_sweep_sql(c, m)}" for c, m in _SWEPT))
def metric_sweep_table(spark, sf):
    rows = B.scored(spark, sf)
    made = [rows.withColumn("score", F.greatest(F.col("score") - m, F.lit(0.0))).withColumn("config", F.lit(c)) for c, m in _SWEPT]
    return metrics.sweep_table(made[0].unionByName(made[1]))


# TF-IDF ---------------------------------------------------------------------

_TFIDF = r"""words AS (SELECT contract, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM contracts),
tokens AS (SELECT contract, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tfs AS (SELECT contract, term, count(*) AS tf FROM tokens GROUP BY ALL), total AS (SELECT count(*) AS n FROM contracts),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT contract, term, (1 + ln(CAST(tf AS DOUBLE))) * (ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tfs JOIN dfs USING (term), total WHERE df <= 0.95 * n),
norm AS (SELECT contract, sum(CAST(floor(w * w * 1e9) AS BIGINT)) AS sq FROM raw GROUP BY contract),
weights AS (SELECT contract, term, w / sqrt(sq / 1e9::DOUBLE) AS weight FROM raw JOIN norm USING (contract))"""


def _weights(spark, sf):
    return tfidf.weights(B.contracts(spark, sf), "contract")


@query("tfidf_weights", with_sql("SELECT contract, term, round(weight, 6) AS weight FROM weights", "contracts", more=_TFIDF))
def tfidf_weights(spark, sf):
    return _weights(spark, sf).withColumn("weight", F.round("weight", 6))


@query("win_top_terms", with_sql(f"""SELECT "group", rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY weight DESC, term) AS rank FROM (SELECT lang AS "group", term, sum({_fixed('weight')}) / {metrics.SCALE}::DOUBLE AS weight FROM weights JOIN (SELECT CAST(doc_id AS VARCHAR) AS contract, lang FROM documents) USING (contract) GROUP BY ALL)) WHERE rank <= 15""", "contracts", more=_TFIDF))
def win_top_terms(spark, sf):
    docs = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("contract"), "text", F.col("lang").alias("group"))
    top = tfidf.top_terms(tfidf.summed(tfidf.weights(docs, "contract", carry=("group",)), "group"), "group")
    return top.withColumn("rank", F.col("rank").cast("long")).withColumn("weight", F.round("weight", 6))


def _labels_long(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("category_idx"), F.col(c).alias("label")) for i, c in enumerate(("quality", "toxic"))))
    return rows.select(F.col("doc_id").cast("string").alias("contract"), F.col("doc_id").cast("string").alias("chunk_id"), "text", (F.col("doc_id") % 3).cast("int").alias("fold"), F.explode(pairs).alias("p")).select("contract", "chunk_id", "text", "fold", "p.*", F.lit(True).alias("mask"))


_FOLD_TERMS = r"""docs AS (SELECT doc_id % 3 AS fold, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM labels JOIN documents USING (doc_id)),
seen AS (SELECT i, fold, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])))) AS term FROM (SELECT row_number() OVER () AS i, * FROM docs)),
models AS (SELECT NULL AS held UNION ALL SELECT DISTINCT fold FROM docs),
sizes AS (SELECT m.held, count(*) AS n FROM models m JOIN docs d ON m.held IS NULL OR d.fold <> m.held GROUP BY m.held),
dfs AS (SELECT m.held, term, count(*) AS df FROM models m JOIN seen s ON m.held IS NULL OR s.fold <> m.held GROUP BY m.held, term)"""


@query("tfidf_fold_vocabularies", f"WITH {_FOLD_TERMS} SELECT CAST(coalesce(d.held, -1) AS INTEGER) AS held, term, df, round(ln((1.0::DOUBLE + n) / (1 + df)) + 1, 9) AS idf FROM dfs d JOIN sizes s ON s.held IS NOT DISTINCT FROM d.held WHERE df >= 2 AND df <= 0.95::DOUBLE * n")
def tfidf_fold_vocabularies(spark, sf):
    rows = _labels_long(spark, sf).where("category_idx = 0")
    return tfidf.fold_vocabularies(rows).withColumn("idf", F.round("idf", 9)).withColumn("held", F.coalesce("held", F.lit(-1)))


@query("tfidf_logreg_score")
def tfidf_logreg_score(spark, sf):
    """The scores are those of the saved and loaded model, which must be the same bit for bit."""
    rows = _labels_long(spark, sf)
    model = tfidf.fit(rows.where("fold <> 0"))
    path = f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    model.save(path)
    held = rows.where("fold = 0")
    texts = held.select("chunk_id", "text").distinct()
    scores = tfidf.Model.load(path).transform(texts)
    tfidf.require_same_scores(model.predict(texts), scores, "chunk_id")
    model.forget()
    forget(spark, path)
    return held.drop("text").join(scores.drop("category_idx"), ["chunk_id", "category"])


@query("tfidf_tuned_run")
def tfidf_tuned_run(spark, sf):
    """Documents whose number is divisible by 5 are the test set, the rest has three folds."""
    rows = _labels_long(spark, sf)
    test = F.col("contract").cast("long") % 5 == 0
    return tfidf.run_report(tfidf.tuned_run(rows.where(~test), rows.where(test)))


@query("tfidf_oof")
def tfidf_oof(spark, sf):
    return tfidf.out_of_fold(_labels_long(spark, sf))


# Risk -----------------------------------------------------------------------


_FLAGS = "flags AS (" + " UNION ALL ".join(f"SELECT chunk_id, category, '{a.name}' AS adjustment, {a.points} AS points FROM risky WHERE category IN ({', '.join(repr(c) for c in a.categories)}) AND regexp_matches(text, '{_rule_sql(a.pattern)}')" for a in risk.ADJUSTMENTS) + ")"
_RISK = _FLAGS + ", points(category, p) AS (VALUES " + ", ".join(f"('{c}', {p})" for c, p in risk.BASE.items()) + ")" + """,
risk AS (SELECT r.*, CASE WHEN trim(text) <> '' THEN p END AS base, CASE WHEN p IS NOT NULL AND trim(text) <> '' THEN coalesce(most, 0) END AS points FROM risky r LEFT JOIN points USING (category) LEFT JOIN (SELECT chunk_id, max(points) AS most FROM flags GROUP BY chunk_id) USING (chunk_id)),
reviewed AS (SELECT *, base + points AS score, CASE WHEN base + points >= 4 THEN 'High' WHEN base + points >= 2 THEN 'Medium' WHEN base IS NOT NULL THEN 'Low' END AS level, base IS NULL OR base + points >= 4 AS needs_review FROM risk)"""


@query("risk_adjustments", with_sql("SELECT chunk_id, category, adjustment, points FROM flags", "risky", more=_FLAGS))
def risk_adjustments(spark, sf):
    return risk.adjustments(B.risk_clauses(spark, sf).select("chunk_id", "category", "text")).where("matched").select("chunk_id", "category", "adjustment", "points")


@query("risk_score", with_sql("SELECT chunk_id, coalesce(base, -1) AS base, coalesce(points, -1) AS points, coalesce(score, -1) AS score, level, needs_review FROM reviewed", "risky", more=_RISK))
def risk_score(spark, sf):
    scored = risk.score_clauses(B.risk_clauses(spark, sf).select("chunk_id", "category", "text"))
    return scored.select("chunk_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("base", "points", "score")), "level", "needs_review")


@query("risk_review", with_sql("SELECT chunk_id, needs_review OR (source <> 'annotation' AND NOT coalesce(NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 AND TRY_CAST(confidence AS DECIMAL(10,6)) >= CAST(threshold AS DECIMAL(10,6)) + 0.10::DECIMAL(4,2) * (1.000000::DECIMAL(10,6) - CAST(threshold AS DECIMAL(10,6))), FALSE)) AS to_review FROM reviewed", "risky", more=_RISK))
def risk_review(spark, sf):
    return risk.route_review(risk.score_clauses(B.risk_clauses(spark, sf))).select("chunk_id", "to_review")


@query("risk_base_points", with_sql("SELECT contract, category, points AS base, CASE WHEN points >= 4 THEN 'High' WHEN points >= 2 THEN 'Medium' ELSE 'Low' END AS level FROM (SELECT DISTINCT contract, category FROM spans) JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {p})" for c, p in risk.BASE.items()) + ") b(category, points)) USING (category)", "spans"))
def risk_base_points(spark, sf):
    scored = risk.score_clauses(B.spans(spark, sf).select("contract", "category", "text"))
    return scored.select("contract", "category", "base", "level").distinct()


def _cap_tables(spark, sf):
    contracts = B.contracts(spark, sf).select("contract", (F.col("doc_id") % 3 != 0).alias("expects_cap"), (F.col("doc_id") % 4 != 0).alias("processed"))
    clauses = B.spans(spark, sf).select("contract", "category", (F.col("start") % 5 == 0).alias("unresolved"))
    return contracts, clauses


_CAPS = """caps AS (SELECT contract, bool_or(start % 5 <> 0) AS found, bool_or(start % 5 = 0) AS open FROM spans WHERE category = 'Cap On Liability' GROUP BY contract),
missing AS (SELECT c.contract, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND NOT coalesce(found, FALSE) AND NOT coalesce(open, FALSE) THEN 0.5 ELSE 0.0 END::DOUBLE AS missing_points, doc_id % 3 <> 0 AND NOT coalesce(found, FALSE) AND (doc_id % 4 = 0 OR coalesce(open, FALSE)) AS check_review FROM contracts c LEFT JOIN caps USING (contract))"""


@query("risk_missing_cap", with_sql("SELECT * FROM missing", "spans", more=_CAPS))
def risk_missing_cap(spark, sf):
    return risk.missing_cap(*_cap_tables(spark, sf)).drop("message")


_POINTS = "points(category, score) AS (VALUES " + ", ".join(f"('{c}', {p})" for c, p in risk.BASE.items()) + ")"


@query("risk_triage", with_sql("SELECT m.contract, coalesce(max(score), 0) + any_value(missing_points) AS triage_score, CAST(coalesce(sum(CASE WHEN score >= 4 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_high, count(score) AS n_clauses FROM missing m LEFT JOIN spans s USING (contract) LEFT JOIN points USING (category) GROUP BY m.contract", "spans", more=_CAPS + ",\n" + _POINTS))
def risk_triage(spark, sf):
    scored = risk.score_clauses(B.spans(spark, sf).select("contract", "category", "text"))
    return risk.triage(scored, risk.missing_cap(*_cap_tables(spark, sf)))


@query("risk_validation", with_sql("""SELECT 'spearman' AS metric, round(corr(rx, ry), 9) AS value FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY expert_score) + (count(*) OVER (PARTITION BY expert_score) - 1) / 2.0 AS ry FROM v)
UNION ALL SELECT 'bucket_agreement', sum(CASE WHEN l(score) = l(expert_score) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) FROM v
UNION ALL SELECT 'high_risk_recall', sum(CASE WHEN score >= 4 AND expert_score >= 4 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN expert_score >= 4 THEN 1 ELSE 0 END) AS DOUBLE) FROM v
UNION ALL SELECT 'precision_at_k', sum(CASE WHEN expert_score >= 4 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) FROM (SELECT * FROM v ORDER BY score DESC, contract LIMIT 10)""".replace("l(score) = l(expert_score)", "(CASE WHEN score >= 4 THEN 2 WHEN score >= 2 THEN 1 ELSE 0 END) = (CASE WHEN expert_score >= 4 THEN 2 WHEN expert_score >= 2 THEN 1 ELSE 0 END)"), "contracts", more="v AS (SELECT contract, doc_id * 7 % 13 / 2 AS score, doc_id * 5 % 11 / 2 AS expert_score FROM contracts)"))  # fmt: skip
def risk_validation(spark, sf):
    rows = B.contracts(spark, sf).select("contract", (F.col("doc_id") * 7 % 13 / 2).alias("score"), (F.col("doc_id") * 5 % 11 / 2).alias("expert_score"))
    return risk.validation(rows).withColumn("value", F.when(F.col("metric") == "spearman", F.round("value", 9)).otherwise(F.col("value")))


# Checks ---------------------------------------------------------------------


def _broken_chunks(spark, sf):
    rows = B.windows(spark, sf).where("length(text) > 0").withColumn("n_tokens", F.lit(5).cast("long"))
    k = F.col("start") / B.STRIDE_CHARS
    return rows.withColumn("text", F.when((F.col("doc_id") % 11 == 0) & (k == 0), F.lit("tampered")).otherwise(F.col("text"))).withColumn("n_tokens", F.when((F.col("doc_id") % 13 == 0) & (k == 1), F.lit(0).cast("long")).otherwise(F.col("n_tokens")))


@query("check_chunks", with_sql("""SELECT 'text' AS "check", chunk_id AS key FROM windows WHERE doc_id % 11 = 0 AND start = 0 UNION ALL SELECT 'n_tokens', chunk_id FROM windows WHERE doc_id % 13 = 0 AND start = 300
UNION ALL SELECT 'advance', chunk_id FROM (SELECT chunk_id, "end", max("end") OVER (PARTITION BY contract ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows) WHERE "end" <= reach""", "windows"))  # fmt: skip
def check_chunks(spark, sf):
    return checks.chunk_violations(B.contracts(spark, sf), _broken_chunks(spark, sf))


@query("check_labels", with_sql("SELECT 'masked positive' AS \"check\", chunk_id || '|' || category AS key FROM labeled WHERE NOT mask AND doc_id % 2 = 0", "labeled"))
def check_labels(spark, sf):
    rows = B.scored(spark, sf)
    return checks.label_violations(rows.withColumn("label", F.when(~F.col("mask") & (F.col("doc_id") % 2 == 0), 1).otherwise(F.col("label"))))


@query("check_predictions", with_sql("SELECT 'missing' AS \"check\", chunk_id AS key FROM windows WHERE doc_id % 17 = 0 UNION ALL SELECT 'range', chunk_id FROM scored WHERE doc_id % 19 = 0 AND doc_id % 17 <> 0 AND category_idx = 0", "scored"))
def check_predictions(spark, sf):
    rows = B.scored(spark, sf)
    given = rows.where("doc_id % 17 <> 0").withColumn("score", F.when((F.col("doc_id") % 19 == 0) & (F.col("category_idx") == 0), F.lit(1.5)).otherwise(F.col("score")))
    return checks.prediction_violations(rows, given)


@query("content_hash")
def content_hash(spark, sf):
    n, h = annotations.content_hash(B.spans(spark, sf))
    return spark.createDataFrame([(n, str(h))], "n long, hash string")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Windows labelled from spans and scored: masked metrics by category, macro and micro."""
    return metric_score(spark, sf)


