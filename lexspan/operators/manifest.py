"""What a stage read and wrote, and a chain of such statements from stage to stage.

A table's digest does not depend on the order of its rows, but counts repeated ones: two sums
of 60-bit numbers from the MD5 of each row's text, so any engine can give it. Files are named
by their SHA-256.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.checks import require_empty
from lexspan.sources.annotations import publish_json

_BITS = 60


def _text_of(frame: DataFrame, name: str) -> Column:
    column = F.col("`" + name.replace("`", "``") + "`")
    kind = dict(frame.dtypes)[name]
    plain = column if not kind.startswith(("array", "struct", "map")) else F.to_json(column)
    return F.coalesce(plain.cast("string"), F.lit("\\N"))


def row_digests(frame: DataFrame) -> DataFrame:
    """``a``, ``b``: two 60-bit numbers of each row, from its columns in the order of their names (null is ``\\N``)."""
    h = F.md5(F.concat_ws("\x1f", *(_text_of(frame, c) for c in sorted(frame.columns))))
    return frame.select(*(F.conv(F.substring(h, i, _BITS // 4), 16, 10).cast("decimal(38,0)").alias(n) for n, i in (("a", 1), ("b", 1 + _BITS // 4))))


def digest_table(frame: DataFrame) -> DataFrame:
    """One row: ``rows``, and ``a`` and ``b``, the sums of ``row_digests`` modulo 2**60."""
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0)) % F.lit(1 << _BITS)).cast("long").alias(c)
    return row_digests(frame).agg(F.count("*").alias("rows"), total("a"), total("b"))


def digest(frame: DataFrame) -> str:
    """Equal for equal rows, equally often, in any order."""
    r = digest_table(frame).first()
    return f"{r['rows']}-{r['a']:015x}{r['b']:015x}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (below the path), ``bytes`` and ``sha256`` of every file in a folder; each is read by one task, whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    return files.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_id(manifest: Mapping) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest; fails if its own identity is not that of its contents."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a small file
    told = json.loads(text)
    if told.pop("id") != manifest_id(told):
        raise ValueError(f"{path} was changed")
    return told | {"id": manifest_id(told)}


def count_differences(found: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """``name, expected, found`` of every count that differs; ``found``: name, n. Counts that are nowhere expected do not matter."""
    wanted = found.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    told = wanted.join(found.select("name", F.col("n").alias("found")), "name", "left")  # a row per count
    return told.where(~F.col("expected").eqNullSafe(F.col("found")))


def run_stage(spark: SparkSession, name: str, inputs: Mapping[str, DataFrame], make: Callable[..., DataFrame], path: str, before: Mapping[str, str] | None = None, expected: Mapping[str, int] | None = None, counts: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Run a stage, write its table to ``path/table`` and, last of all, its manifest to ``path/manifest.json``; returns the manifest.

    ``before`` names, for inputs that an earlier stage made, that stage's manifest: the stage is
    refused if the input's digest is not the one written there. The table is read back and must
    hold the rows that were made. ``counts`` (name, n) of what was written must be ``expected``.
    """
    told, chain = {}, {}
    for key, frame in inputs.items():
        told[key] = digest(frame)
        if before and key in before:
            earlier = read_manifest(spark, before[key])
            if earlier["output"] != told[key]:
                raise ValueError(f"{name}: {key} is not what {earlier['stage']} wrote")
            chain[key] = earlier["id"]
    made = make(**inputs)
    made.write.mode("overwrite").parquet(f"{path}/table")
    again = spark.read.parquet(f"{path}/table")
    output = digest(again)
    if output != digest(made):
        raise ValueError(f"{name}: {path} does not hold what was made")
    found = counts(again) if counts else None
    if expected:
        require_empty(count_differences(found, expected), f"{name}: counts differ")
    manifest = {"stage": name, "inputs": told, "before": chain, "output": output, "files": [r.asDict() for r in file_digests(spark, f"{path}/table").where("file like 'part-%'").orderBy("file").collect()], "counts": {r["name"]: r["n"] for r in found.collect()} if found is not None else {}}
    publish_json(spark, manifest | {"id": manifest_id(manifest)}, f"{path}/manifest.json")
    return manifest | {"id": manifest_id(manifest)}
