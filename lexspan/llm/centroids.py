"""Clusters around centroids, in exact integers, with block-norm screening.

Each vector is stored with a compressed form: the norms of its segments. By Cauchy and
Schwarz, within a segment a vector and a centroid are at least the difference of their norms
apart, so the compressed forms alone give a lower bound on each distance. A vector's distance
to the centroid of least bound is taken exactly first; of the others only those whose bound
does not exceed it get an exact distance.

Vectors never leave their partition: a round sends a partial sum a cluster and task, and only
the centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.vectors import kept_vectors, scaled
from lexspan.session import forget, settled, ship, spill, table

#: Components of a segment.
SEGMENT = 8
#: Rounding of norms (doubles) is far below this share of a bound.
SLACK = 1e-9
_STORED = "x binary, norms binary"


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The norm of every segment of each row."""
    padded = np.pad(x, ((0, 0), (0, -x.shape[1] % segment))).reshape(len(x), -1, segment)
    return np.sqrt((padded * padded).sum(axis=2).astype(np.float64))


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """A bound from below on the squared distance of each row to each centroid, from segment norms alone."""
    squares = (norms * norms).sum(axis=1)[:, None] + (centroid_norms * centroid_norms).sum(axis=1)[None, :]
    return squares - 2 * (norms @ centroid_norms.T) - SLACK * (squares + 1)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (of equals the smaller number), its squared distance, and how many exact distances were taken."""
    bounds = lower_bounds(norms, segment_norms(centroids))
    first = bounds.argmin(axis=1)
    difference = x - centroids[first]
    best = (difference * difference).sum(axis=1)
    rest = bounds <= best[:, None]
    rest[np.arange(len(x)), first] = False
    cluster, taken = first.copy(), len(x)
    for k in range(len(centroids)):  # a centroid with all the rows that it is still open for
        rows = np.flatnonzero(rest[:, k])
        rows = rows[bounds[rows, k] <= best[rows]]  # the best distance has fallen meanwhile
        taken += len(rows)
        difference = x[rows] - centroids[k]
        found = (difference * difference).sum(axis=1)
        closer = (found < best[rows]) | ((found == best[rows]) & (k < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = found[closer], k
    return cluster, best, taken


def packed(vectors: DataFrame, key: str, vector: str, dimensions: int, factor: int) -> DataFrame:
    """``key`` with the integer vector and its segment norms (both binary) of every row that takes part."""
    ship(vectors.sparkSession)
    named = vectors.select(vectors[_quoted(key)].alias("key"), vectors[_quoted(vector)].alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(kept_vectors(batch.column("vector"), dimensions)))
            x = scaled(batch.column("vector"), factor)
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column("key"), _binary(x.astype("<i4")), _binary(segment_norms(x).astype("<f8"))], ["key", "x", "norms"])

    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, {_STORED}")


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value per row."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)[: len(rows) + 1]), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, _matrix(batch.column("x"), "<i4", batch.num_rows).astype(np.int64), _matrix(batch.column("norms"), "<f8", batch.num_rows)


def partial_sums(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dimension (-1: the number of vectors) and the exact sum over all vectors; empty clusters have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, x, norms in _unpacked(batches):
            cluster, _, _ = nearest(x, norms, centroids)
            order = np.argsort(cluster, kind="stable")
            begins = np.flatnonzero(np.concatenate(([True], np.diff(cluster[order]) > 0)))
            sums[cluster[order][begins]] += np.add.reduceat(x[order], begins, axis=0)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        values = np.concatenate((counts[used, None], sums[used]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, d, dtype=np.int32), len(used))), pa.array(values.ravel())], ["cluster", "dimension", "value"])

    told = stored.mapInArrow(run, "cluster int, dimension int, value long")
    return told.groupBy("cluster", "dimension").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of each component's mean; those without vectors stay."""
    d = centroids.shape[1]
    sums: dict[int, dict[int, int]] = {}
    for r in partial_sums(stored, centroids).collect():  # a row per centroid and component at most
        sums.setdefault(r["cluster"], {})[r["dimension"]] = int(r["value"])
    out = centroids.copy()
    for cluster, own in sums.items():
        out[cluster] = [own[i] // own[-1] for i in range(d)]
    return out


def first_centroids(stored: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:key`` has the smallest SHA-256 (hex), in that order; null keys last, equal ones by vector."""
    chosen = stored.select("key", "x").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in chosen], np.int64)


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster and distance (squared) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, norms in _unpacked(batches):
            cluster, distance, _ = nearest(x, norms, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    return stored.mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, factor: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The clusters of ``vectors`` after ``rounds`` rounds, and the final centroids (a row each).

    Columns: the key, ``cluster``, ``distance`` (squared, to the centroid), and ``cluster_inertia``
    and ``inertia``, its sums over the cluster and over all.

    Rows take part whose vector has ``dimensions`` components, none null or non-finite;
    components are ``floor(factor * x)`` and must be smaller than 2**26 (an error otherwise).
    Rows with null or equal keys are vectors of their own. With fewer vectors than ``k``
    each is a first centroid; equal centroids leave all vectors to the smaller number. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    stored, path = spill(spark, packed(vectors, key, vector, dimensions, factor))
    centroids = first_centroids(stored, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(stored, centroids)
    found = settled(spark, assigned(stored, centroids) if len(centroids) else stored.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    forget(spark, path)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    sums = {r["cluster"]: int(r["cluster_inertia"]) for r in sums.collect()}  # a row per centroid at most
    rows = spark.createDataFrame([(c, s, sum(sums.values())) for c, s in sorted(sums.items())], "its_cluster int, cluster_inertia long, inertia long")
    out = found.join(F.broadcast(rows), F.col("cluster") == F.col("its_cluster"))
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia"), centroids


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = F.create_map(*[F.lit(v) for i, c in enumerate(centroids) for v in (i, centroid_digest(c))]) if len(centroids) else F.create_map().cast("map<int,string>")
    return found.withColumn("centroid_sha256", digests[F.col("cluster")])
