"""op6: secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .credentials import digest, scan


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


QUERIES = {"op6_secrets": (op6_secrets, None)}
