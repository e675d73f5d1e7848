"""What every operator needs from the session: shipped code and shared folders."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Bytes of an Arrow batch that a session with Spark's own setting gets: whole texts of any length stay few in a worker.
_ARROW, _ARROW_DEFAULT, _ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20
#: Whether queries delete their shuffle files when they end, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installed copy, and keep Arrow batches small."""
    context = spark.sparkContext
    if str(spark.conf.get(_ARROW, None)).removesuffix("b") == str(_ARROW_DEFAULT):
        spark.conf.set(_ARROW, str(_ARROW_BYTES))
    if getattr(context, "_lexspan_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "lexspan_code.zip"  # the driver serves it; executors fetch it from there
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, os.path.join("lexspan", source.relative_to(_PACKAGE)))
    context.addPyFile(str(target))
    context._lexspan_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is one made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark.sparkContext, "_lexspan_shared", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="lexspan")
            spark.sparkContext._lexspan_shared = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned inside delete their shuffle files when they end; the session's own setting comes back after."""
    had = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, had)


def spill(spark: SparkSession, frame: DataFrame) -> tuple[DataFrame, str]:
    """Write ``frame`` as Parquet in the shared folder and read it again; cuts the lineage. Returns it and its path.

    The shuffle files of what made it go as soon as it is written.
    """
    path = f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def spill_bucketed(spark: SparkSession, frame: DataFrame, buckets: int, key: str) -> tuple[DataFrame, str, str]:
    """As ``spill``, in buckets of ``key``: joins and groups on it do not move the table. Also the table's name and path."""
    name, path = f"lexspan_{uuid.uuid4().hex}", f"{shared_folder(spark)}/lexspan/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        frame.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def drop_bucketed(spark: SparkSession, name: str, path: str) -> None:
    """Delete a table that ``spill_bucketed`` wrote."""
    spark.sql(f"DROP TABLE {name}")
    forget(spark, path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``spill`` wrote, on whatever file system they are."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def settled(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A stored result, in the shared folder: it outlives the tables it was made from and lost executors."""
    return spill(spark, frame)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
