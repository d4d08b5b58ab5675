"""op10: quality score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .quality import THRESHOLD, Network, fit, quality_scores, training_rows


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    return fit(*training_rows(docs, labels, lambda doc_id: ~held_out(doc_id, 5, 0)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, trained(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality": (op10_quality, None)}
