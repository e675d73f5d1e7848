"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.session import forget, ship, spill

MAX_ROUNDS = 60
#: Edges that one task contracts by itself; their number sets how many tasks share the edges.
TASK_EDGES = 250_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges: every node with the smallest node that these edges reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``. The edges are dealt evenly over tasks of
    about ``TASK_EDGES``, each of which replaces its own by one edge from every node to the
    smallest it reaches. Unless one task was enough, large-star and small-star steps join
    what the tasks found: every step hangs nodes on smaller neighbours and never makes more
    edges than there were, so a hub with a third of all nodes stays a list of single edges.
    Each round is stored in the shared folder, and the rounds end when the edges no longer change.
    """
    spark = edges.sparkSession
    ship(spark)
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    now, path = spill(spark, edges.select("a", "b").repartition(tasks).mapInArrow(_contracted, "a long, b long"))
    if tasks == 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = now.where("a <> b").distinct()
    state = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == state:
            break
        state = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before = path
        now, path = spill(spark, small)
        forget(spark, before)
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
