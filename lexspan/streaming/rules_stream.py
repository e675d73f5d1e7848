"""Clause rules on a stream of contracts.

Cutting into windows and matching rules keep no state, so the batch operators run
unchanged under ``readStream``; counts by category use a watermark on arrival time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.chunking import fixed_windows
from lexspan.operators.rules import RULES, Rule, category_scores

SCHEMA = "contract string, split string, text string, arrived timestamp"


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts that arrive as Parquet files in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def detect(contracts: DataFrame, rules: tuple[Rule, ...] = RULES, size: int = 400, stride: int = 300) -> DataFrame:
    """Windows of arriving contracts with the categories whose rules fire."""
    windows = fixed_windows(contracts.select("contract", "split", "text"), size, stride)
    return category_scores(windows, rules).where("n_rules > 0")


def arrivals(contracts: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Contracts per stretch of arrival time; later ones than ``late`` are left out."""
    return contracts.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("contracts"), F.sum(F.length("text")).alias("n_chars")).select(F.col("window.start").alias("start"), "contracts", "n_chars")
