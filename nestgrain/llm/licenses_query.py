"""op9: license wording of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import digest, license_scan


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(license_scan(table(spark, sf_dir, "documents")))


QUERIES = {"op9_licenses": (op9_licenses, None)}
