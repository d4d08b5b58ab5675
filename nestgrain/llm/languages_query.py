"""op8: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import held_out, table
from .languages import identify, learn


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs, lambda doc_id: ~held_out(doc_id, 4, 2))
    found = identify(docs, trees)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_languages": (op8_languages, None)}
