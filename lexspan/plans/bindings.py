"""The driver's tables as contracts, spans, windows, labels and scores, by integer arithmetic only.

``SQL`` holds the same tables as common table expressions for DuckDB; ``with_sql``
puts them before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.plans.samples import CLAUSES, RISK
from lexspan.schema import CATEGORIES
from lexspan.session import table

WINDOW_CHARS, STRIDE_CHARS = 400, 300
CLAUSE_TEXTS = [text for _, text in CLAUSES]
RISK_TEXTS = [text for _, _, text in RISK]


def category_at(index) -> F.Column:
    return F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (index + 1).cast("int"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("length(text) > 0").select(
        F.col("doc_id").cast("string").alias("contract"), "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k")
    rows = contracts(spark, sf_dir).select("contract", "doc_id", "split", "text", "n_chars", k)
    start = (F.col("doc_id") * 37 + F.col("k") * 101) % F.col("n_chars")
    rows = rows.withColumn("start", start).withColumn("end", F.least(F.col("start") + 20 + (F.col("doc_id") * 13 + F.col("k") * 7) % 200, F.col("n_chars")))
    rows = rows.withColumn("category", category_at((F.col("doc_id") + 3 * F.col("k")) % 10)).where("start < end")
    return rows.select("contract", "split", "category", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("text"), "start", "end", "n_chars")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(STRIDE_CHARS).cast("long"))).alias("start")
    rows = contracts(spark, sf_dir).select("contract", "doc_id", "split", "text", "n_chars", start)
    rows = rows.withColumn("end", F.least(F.col("start") + WINDOW_CHARS, F.col("n_chars")))
    chunk = F.concat_ws(":", "contract", F.col("start").cast("string"), F.col("end").cast("string"))
    return rows.select("contract", "doc_id", "split", chunk.alias("chunk_id"), "start", "end", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("text"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a sentence of a contract after their own text, since the tables' invented prose has no legal words."""
    told = F.element_at(F.array(*(F.lit(t) for t in CLAUSE_TEXTS)), ((F.col("doc_id") + F.floor(F.col("start") / STRIDE_CHARS)) % len(CLAUSE_TEXTS) + 1).cast("int"))
    return windows(spark, sf_dir).select("contract", "chunk_id", "start", "end", F.concat("text", F.lit(" "), told).alias("text"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as nested annotation records (``title``, ``paragraphs``); each contract has an entry, and its contract a question without answers."""
    from lexspan.schema import RAW_JSON

    told = spans(spark, sf_dir).select("contract", F.struct(F.concat("contract", F.lit("__"), "category").alias("id"), F.lit("?").alias("question"), F.lit(False).alias("is_impossible"), F.array(F.struct("text", F.col("start").alias("answer_start"))).alias("answers")).alias("qa"))
    none = F.struct(F.concat("contract", F.lit("__Exclusivity_1")).alias("id"), F.lit("?").alias("question"), F.lit(True).alias("is_impossible"), F.array().cast("array<struct<text:string,answer_start:bigint>>").alias("answers"))
    asked = told.groupBy("contract").agg(F.collect_list("qa").alias("qas"))
    rows = contracts(spark, sf_dir).select("contract", "text", none.alias("none")).join(asked, "contract")
    entry = F.struct(F.concat(F.lit(" "), "contract").alias("title"), F.array(F.struct(F.col("text").alias("context"), F.concat("qas", F.array("none")).alias("qas"))).alias("paragraphs"))
    return rows.select("contract", entry.alias("entry"))


def risk_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a category, now and then an unknown one, and a risky sentence after their own text; some have no words. With a detector's confidence and threshold."""
    n = F.col("doc_id") + F.floor(F.col("start") / STRIDE_CHARS)
    told = F.element_at(F.array(*(F.lit(t) for t in RISK_TEXTS)), (n % len(RISK_TEXTS) + 1).cast("int"))
    category = F.when(n % 23 == 0, F.lit("Parties")).otherwise(category_at(n % 10))
    confidence = F.when(n % 13 == 0, F.lit(None).cast("double")).when(n % 17 == 0, F.lit(float("nan"))).otherwise((n * 37 % 1011) / F.lit(1000.0))
    return windows(spark, sf_dir).select(
        "contract", "chunk_id", category.alias("category"), F.when(n % 19 == 0, F.lit("  ")).otherwise(F.concat("text", F.lit(" "), told)).alias("text"),
        F.when(n % 5 == 0, F.lit("annotation")).otherwise(F.lit("model")).alias("source"), confidence.alias("confidence"), (n % 7 / F.lit(10.0)).alias("threshold"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per window, in one of five folds, with arrays of ``labels``, ``label_mask`` and ``scores`` in category order."""
    from lexspan.operators.labeling import evidence, label_arrays

    own = windows(spark, sf_dir).select("contract", "doc_id", "chunk_id", "start", "end")
    labeled = label_arrays(own, evidence(own, spans(spark, sf_dir)))
    base = F.col("doc_id") * 7919 + F.floor(F.col("start") / STRIDE_CHARS) * 104729
    lift = lambda label: label * 300  # noqa: E731  positives score higher, so that tuning has something to find
    scores = F.transform("labels", lambda label, i: F.least((base + i * F.lit(1299709).cast("long")) % 1000 + lift(label), F.lit(999).cast("long")) / F.lit(1000.0))
    return labeled.withColumn("scores", scores).withColumn("fold", (F.col("doc_id") % 5).cast("int"))


def long(rows: DataFrame) -> DataFrame:
    """``wide`` rows by category, with ``label``, ``mask`` and ``score``."""
    names = F.array(*(F.lit(c) for c in CATEGORIES))
    kept = [c for c in rows.columns if c not in ("labels", "label_mask", "scores")]
    told = rows.select(*kept, F.posexplode(F.arrays_zip("labels", "label_mask", "scores")).alias("category_idx", "v"))
    return told.select(*kept, F.element_at(names, F.col("category_idx") + 1).alias("category"), "category_idx", F.col("v.labels").alias("label"), F.col("v.label_mask").alias("mask"), F.col("v.scores").alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows by category with a score and one of five folds."""
    rows = long(wide(spark, sf_dir))
    return rows.select(*(c for c in rows.columns if c != "fold"), "fold")


_CATS = ", ".join(f"('{c}', {i})" for i, c in enumerate(CATEGORIES))
SQL = {
    "cats": f"cats(category, category_idx) AS (VALUES {_CATS})",
    "contracts": "contracts AS (SELECT CAST(doc_id AS VARCHAR) AS contract, doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE length(text) > 0)",
    "spans": """spans0 AS (SELECT c.*, k, (doc_id * 37 + k * 101) % n_chars AS start FROM contracts c, (SELECT unnest([0, 1, 2, 3]) AS k)),
spans1 AS (SELECT *, least(start + 20 + (doc_id * 13 + k * 7) % 200, n_chars) AS "end" FROM spans0),
spans AS (SELECT contract, split, category, substring(text, CAST(start + 1 AS BIGINT), CAST("end" - start AS BIGINT)) AS text, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", n_chars FROM spans1 JOIN cats ON category_idx = (doc_id + 3 * k) % 10 WHERE start < "end")""",
    "windows": f"""windows0 AS (SELECT *, unnest(range(0, n_chars, {STRIDE_CHARS})) AS start FROM contracts),
windows AS (SELECT contract, doc_id, split, concat_ws(':', contract, start, least(start + {WINDOW_CHARS}, n_chars)) AS chunk_id, start, least(start + {WINDOW_CHARS}, n_chars) AS "end", substring(text, start + 1, least(start + {WINDOW_CHARS}, n_chars) - start) AS text FROM windows0)""",
    "clauses": f"""clauses AS (SELECT contract, chunk_id, start, "end", text || ' ' || [{', '.join("'" + t.replace("'", "''") + "'" for t in CLAUSE_TEXTS)}][(doc_id + start // {STRIDE_CHARS}) % {len(CLAUSE_TEXTS)} + 1] AS text FROM windows)""",
    "risky": f"""risky0 AS (SELECT *, doc_id + start // {STRIDE_CHARS} AS n FROM windows),
risky AS (SELECT contract, chunk_id, CASE WHEN n % 23 = 0 THEN 'Parties' ELSE c.category END AS category, CASE WHEN n % 19 = 0 THEN '  ' ELSE text || ' ' || [{', '.join("'" + t.replace("'", "''") + "'" for t in RISK_TEXTS)}][n % {len(RISK_TEXTS)} + 1] END AS text,
CASE WHEN n % 5 = 0 THEN 'annotation' ELSE 'model' END AS source, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 17 = 0 THEN 'nan'::DOUBLE ELSE n * 37 % 1011 / 1000.0::DOUBLE END AS confidence, n % 7 / 10.0::DOUBLE AS threshold FROM risky0 JOIN cats c ON c.category_idx = n % 10)""",
    "evidence": """evidence AS (SELECT DISTINCT w.chunk_id, w.contract, s.category, s.start AS span_start, s."end" AS span_end, greatest(w.start, s.start) AS overlap_start, least(w."end", s."end") AS overlap_end, w.start <= s.start AND s."end" <= w."end" AS fully_contained
FROM windows w JOIN spans s ON w.contract = s.contract AND w.start < s."end" AND s.start < w."end")""",
    "labeled": """touched AS (SELECT chunk_id, category, bool_or(fully_contained) AS full_ FROM evidence GROUP BY chunk_id, category),
labeled AS (SELECT w.contract, w.doc_id, w.chunk_id, w.start, c.category, c.category_idx, CASE WHEN t.full_ THEN 1 ELSE 0 END AS label, t.full_ IS NULL OR t.full_ AS mask FROM windows w CROSS JOIN cats c LEFT JOIN touched t ON t.chunk_id = w.chunk_id AND t.category = c.category)""",
    "scored": f"""scored AS (SELECT *, least((doc_id * 7919 + (start // {STRIDE_CHARS}) * 104729 + category_idx * 1299709) % 1000 + label * 300, 999) / 1000.0::DOUBLE AS score, CAST(doc_id % 5 AS INTEGER) AS fold FROM labeled)""",
}
_NEEDS = {"spans": ("cats", "contracts"), "windows": ("contracts",), "clauses": ("windows",), "risky": ("cats", "windows"), "evidence": ("spans", "windows"), "labeled": ("evidence",), "scored": ("labeled",)}


def with_sql(query: str, *names: str, more: str = "") -> str:
    """``query`` after the named tables and all that they need; ``more``: further expressions, comma-separated."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [SQL[n] for n in order] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query
