"""Sinks: CSV with a fixed layout, resumable partitions, atomic publish."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import GateError, require_columns


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, digits: int | None = None, single_file: bool = False, replace: bool = False) -> None:
    """CSV with a header. ``fields`` fixes order and drops the rest; ``digits`` fixes decimals of floating columns.

    One file only on request: that funnels all rows through one task.
    """
    if fields:
        require_columns(df, fields)
        df = df.select(*fields)
    if digits is not None:
        floats = [n for n, t in df.dtypes if t in ("double", "float")]
        df = df.withColumns({n: F.format_string(f"%.{digits}f", F.col(n)) for n in floats}) if floats else df
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite" if replace else "errorifexists").csv(path, header=True, lineSep="\n")


def write_vectors(df: DataFrame, path: str, vector: str, replace: bool = False) -> None:
    """Vector tables go to parquet as array<float>, keyed, never as positional matrices."""
    df.withColumn(vector, F.col(vector).cast("array<float>")).write.mode("overwrite" if replace else "errorifexists").parquet(path)


def finished_cases(spark: SparkSession, path: str, case: str) -> DataFrame | None:
    """Cases already present in a partitioned output, or None when there is no output yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop) or not any(s.isDirectory() for s in system.listStatus(hadoop)):
        return None
    return spark.read.parquet(path).select(F.col(case).cast("string").alias(case)).distinct()


def process_missing_cases(inputs: DataFrame, path: str, case: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Run ``work`` on cases without output and append them, partitioned by case; returns how many were new."""
    done = finished_cases(inputs.sparkSession, path, case)
    todo = inputs if done is None else inputs.join(done, inputs[case].cast("string") == done[case], "left_anti")
    new = todo.select(case).distinct().count()
    if new:
        work(todo).write.mode("append").partitionBy(case).parquet(path)
    return new


def publish(path: str | Path, build: Callable[[Path], None], replace: bool = False) -> Path:
    """Build into a sibling folder, then rename; a failed build leaves no trace of the target.

    For control-sized outputs on a file system the driver sees.
    """
    target = Path(path)
    if target.exists() and not replace:
        raise FileExistsError(f"refusing to overwrite {target}")
    target.parent.mkdir(parents=True, exist_ok=True)
    building = Path(tempfile.mkdtemp(prefix=f".{target.name}.building-", dir=target.parent))
    build(building)
    if target.exists():
        target.rename(building.with_name(building.name.replace("building", "previous")))
    building.rename(target)
    return target


def write_manifest(path: str | Path, fields: dict) -> None:
    """JSON control file, replaced in one step."""
    target = Path(path)
    temporary = target.with_suffix(target.suffix + ".tmp")
    temporary.write_text(json.dumps(fields, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    os.replace(temporary, target)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table; a larger one is refused, not cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise GateError(f"more than {limit} rows do not belong in a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else re.sub(r"\|", r"\\|", str(v)) for v in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"
