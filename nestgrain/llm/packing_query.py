"""op4: all documents packed into sequences of at most 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import packed, token_pieces


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame) -> DataFrame:
    return packed(token_pieces(docs, tokenizer_path()).drop("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": (op4_packing, None)}
