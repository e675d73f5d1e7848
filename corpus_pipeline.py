"""A training corpus from raw documents, in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import decontaminate, jaccard_join, packing, quality_classifier, secrets
from lexspan.llm.language_id import held_out
from lexspan.session import forget, spill, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; rows held out of training teach it nothing here either."""
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality_classifier.keep_good(docs, net)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one document of each group of near duplicates (5-word shingles, Jaccard of 0.8 or more)."""
    return jaccard_join.one_of_each(docs, ngram=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.packed_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("jaccard_join", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: The stages tokenise and train; SQL can't express them. tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, path = spill(spark, stage(spark, docs, sf_dir))
        written.append(path)
    out = STAGES[-1][1](spark, docs, sf_dir)  # checkpointed by the stage: the tables before it may go
    forget(spark, *written)
    return out


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
