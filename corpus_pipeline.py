"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing, over whole documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestgrain.llm.common import sent_if_small, table
from nestgrain.llm.decontamination import contained_items
from nestgrain.llm.minhash import near_duplicates
from nestgrain.llm.packing_query import pack_documents
from nestgrain.llm.quality import THRESHOLD, quality_scores
from nestgrain.llm.quality_query import trained
from nestgrain.llm.credentials import redacted
from nestgrain.session import ensure_checkpoint_dir, materialise


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or it with a number, that ``docs`` has no column of."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n not in taken)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``; rows with a null id stay."""
    gone = _free(docs, "__gone")
    ids = materialise(ids.select(F.col("doc_id").alias(gone)).where(F.col(gone).isNotNull()).distinct())
    return docs.join(sent_if_small(ids, 16), docs["doc_id"] == ids[gone], "left_anti")


# What holds for every stage: all columns of docs come back, whatever their names (doc_id and text are read); an
# empty table gives an empty one; repeated rows are judged each and share their fate; a null id is never dropped.

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of ``labels.quality`` does not reject; the score is worked out row by row, in place.

    A null text is scored as an empty one; a text of any length is read whole. A score equal to
    the threshold stays. Without labels of both kinds nothing is rejected.
    """
    net = trained(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return quality_scores(docs, net, docs.columns, score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Null and empty texts are near nothing and stay. Rows that repeat an id share its fate.
    """
    return _without(docs, near_duplicates(docs).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, nor does anything without items."""
    return _without(docs, contained_items(docs, table(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, texts without a secret stay as they are."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence; a null or empty text is its end id alone.

    Returns the columns of a piece, not those of documents.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
    ("secrets", secret_stage), ("packing", packing_stage),
]

#: A trained network, sketches and a tokenizer are not SQL; tests/llm/test_pipeline.py holds a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back for the next."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
