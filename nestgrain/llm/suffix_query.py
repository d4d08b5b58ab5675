"""op3: bytes of all documents that repeat earlier 100-byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .suffix import digest, without_repeats


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_repeats(table(spark, sf_dir, "documents")))


QUERIES = {"op3_suffix": (op3_suffix, None)}
