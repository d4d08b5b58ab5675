"""op13: ids of a SentencePiece model for all documents, and what they decode to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pieces import encoded


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_path()).drop("ids", "decoded")


QUERIES = {"op13_pieces": (op13_pieces, None)}
