"""Reading and writing: nested JSON, category descriptions, table caches, run results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import title_case
from lexspan.operators import tables
from lexspan.operators.checks import require_empty
from lexspan.schema import CATEGORY_DESCRIPTIONS, RAW_JSON


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The nested annotation files of a path, with their fixed schema."""
    return spark.read.schema(RAW_JSON).option("multiLine", True).json(path)


def build_split(raw: DataFrame) -> dict[str, DataFrame]:
    """contracts, spans (with quality flags) and grid; fails if a span's text is not at its offsets."""
    flat = tables.flatten(raw)
    contracts, spans = tables.contracts_of(flat), tables.spans_of(flat)
    require_empty(tables.offset_mismatches(contracts, spans), "span text does not match its offsets")
    return {"contracts": contracts, "spans": tables.quality_flags(spans), "grid": tables.presence_grid(contracts, spans)}


def write_split(split: dict[str, DataFrame], path: str, name: str) -> None:
    for kind, frame in split.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}_{kind}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load_split(spark: SparkSession, raw_path: str, path: str, name: str, known: tuple[str, ...] = ("train", "test"), rebuild: bool = False) -> dict[str, DataFrame]:
    """The cached tables of a split; built and written first if they are not there."""
    if name not in known:
        raise KeyError(f"unknown split {name!r}")
    kinds = ("contracts", "spans", "grid")
    if rebuild or not all(exists(spark, f"{path}/{name}_{k}/_SUCCESS") for k in kinds):
        write_split(build_split(read_annotations(spark, raw_path)), path, name)
    return {k: spark.read.parquet(f"{path}/{name}_{k}") for k in kinds}


def load_all(spark: SparkSession, raw_paths: dict[str, str], path: str, rebuild: bool = False) -> dict[str, dict[str, DataFrame]]:
    return {name: load_split(spark, raw, path, name, tuple(raw_paths), rebuild) for name, raw in raw_paths.items()}


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """The category descriptions: columns by place, field names stripped from the values, a title-case ``category``."""
    return describe(spark.read.schema(CATEGORY_DESCRIPTIONS).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", "\"").csv(path))


def describe(raw: DataFrame) -> DataFrame:
    bare = lambda c: F.trim(F.regexp_replace(c, r"^(Category|Description|Answer Format|Group):\s*", ""))
    named = raw.select(*(bare(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns, ("category_raw", "description", "answer_format", "group"))))
    return named.select(title_case(F.col("category_raw")).alias("category"), "category_raw", "description", "answer_format", "group")


def match_categories(descriptions: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``json_category``: the known category that is equal but for case, else null."""
    names = known.select(F.col("category").alias("json_category"), F.lower("category").alias("_k")).dropDuplicates(["_k"])
    return descriptions.join(F.broadcast(names), F.lower("category_raw") == F.col("_k"), "left").drop("_k")  # one row per category


def _paths(spark: SparkSession, path: str):
    """The file system of a path, the path, and Hadoop's classes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), target, jvm


def _json_bytes(value: dict) -> bytearray:
    return bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode())


def publish_json(spark: SparkSession, value: dict, path: str) -> None:
    """Write a small JSON file under another name and rename it over what is there: a reader finds the old one or the new one, whole."""
    system, target, jvm = _paths(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(part, True)
    out.write(_json_bytes(value))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, over)


def claim(spark: SparkSession, value: dict, path: str) -> bool:
    """Create a small JSON file unless there is one already; whether this call made it. Of several at once one makes it."""
    system, target, jvm = _paths(spark, path)
    try:
        out = system.create(target, False)
    except Exception as failed:  # py4j wraps what the file system says
        if "FileAlreadyExists" in str(failed) or "already exists" in str(failed):
            return False
        raise
    out.write(_json_bytes(value))
    out.close()
    return True


def test_once(spark: SparkSession, rows: DataFrame, path: str, run: dict, smoke_allowed: bool = False, again: bool = False) -> dict:
    """The lock of the one test run: what it wrote to ``path`` before the test rows may be scored.

    Refuses rows of any other split than ``test``, smoke runs (``run["smoke"]``) unless allowed,
    thresholds (``run["thresholds"]``) other than the selected ones (``run["selected"]``), and a
    second run unless ``again``, which then is marked ``second_run`` and stands beside the first.
    """
    require_empty(rows.where("split is null or split <> 'test'"), "only test rows are scored")
    if run.get("smoke") and not smoke_allowed:
        raise ValueError("a smoke run is not reported")
    if run.get("thresholds") != run.get("selected"):
        raise ValueError("thresholds are not the selected ones")
    sizes = rows.agg(F.count("*").alias("chunks"), F.countDistinct("contract").alias("contracts")).first()
    told = {**run, **sizes.asDict(), "second_run": False}
    if claim(spark, told, path):
        return told
    if not again:
        raise ValueError(f"the test rows were scored before: {path}")
    told["second_run"] = True
    publish_json(spark, told, f"{path}.{uuid.uuid4().hex}")
    return told


test_once.__test__ = False  # not a test


def write_once(frame: DataFrame, path: str) -> None:
    """Write a result that must not be there yet."""
    frame.write.mode("errorifexists").parquet(path)


def verified_write(frame: DataFrame, path: str) -> DataFrame:
    """Write, read back, and fail unless both hold the same rows; returns what was read."""
    frame.write.mode("overwrite").parquet(path)
    again = frame.sparkSession.read.parquet(path)
    if content_hash(frame) != content_hash(again):
        raise ValueError(f"{path} does not hold what was written")
    return again


def content_hash(frame: DataFrame) -> tuple[int, int]:
    """Row count and a sum of row hashes: equal for equal rows in any order."""
    row = frame.select(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(frame.columns))).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def scan_runs(spark: SparkSession, paths: list[str], schema: str, key: tuple[str, ...], expected: dict[str, str]) -> DataFrame:
    """Results of several run folders; fails on none, smoke runs, repeated keys, or inputs other than expected.

    ``schema`` must have ``smoke boolean``, the key columns and those named in ``expected``.
    """
    runs = spark.read.schema(schema).option("multiLine", True).json(paths)
    if runs.isEmpty():
        raise ValueError("no finished runs")
    require_empty(runs.where(F.coalesce("smoke", F.lit(False))), "smoke runs are no results")
    require_empty(runs.groupBy(*key).count().where("count > 1"), "two results for one run")
    for column, value in expected.items():
        require_empty(runs.where(~F.col(column).eqNullSafe(F.lit(value))), f"another {column}")
    return runs


def write_csv(frame: DataFrame, path: str, places: int = 4) -> None:
    """One CSV file with doubles rounded half to even."""
    kinds = dict(frame.dtypes)
    shown: list[Column] = [F.bround(F.col(f"`{c}`"), places).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in frame.columns]
    frame.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(frame: DataFrame, places: int = 4, most: int = 200) -> str:
    """A small table as Markdown; nulls are empty. Fails on more than ``most`` rows."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a Markdown table")
    show = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"
