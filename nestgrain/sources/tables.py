"""Tabular, JSON, text, archive and listing sources."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path, PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null, parse_flag
from ..operators.contracts import GateError, require_columns, require_label_blind, require_single_row
from ..session import materialise
from . import digests

ByteOrderMark = "﻿"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV with a header. The schema is declared, never inferred; NaN and blank become NULL, a cell of another type or a short line is an error."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, nullValue="", mode="FAILFAST", escape='"')
    doubles = {f.name: nan_to_null(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(doubles) if doubles else df


def read_text_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Every column as a string, in file order; a byte-order mark on the header is dropped. Doubled quotes stand for one.

    With ``line_breaks`` a quoted cell may hold line breaks; the file can then not be split between tasks.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=line_breaks)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip(ByteOrderMark)) if first.startswith(ByteOrderMark) else df


def read_columns(spark: SparkSession, path: str, columns: list[str], label_blind: bool = False) -> DataFrame:
    """Parquet or text CSV projected to ``columns``; with ``label_blind`` outcome-like names are refused."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_text_csv(spark, path)
    require_columns(df, columns, path)
    out = df.select(*columns)
    return require_label_blind(out) if label_blind else out


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Schema-only look at a CSV header."""
    return read_text_csv(spark, path).columns


def read_single_row(spark: SparkSession, path: str, per_file: bool = False) -> DataFrame:
    """A metadata table that must hold exactly one row (in all, or in each file)."""
    df = read_text_csv(spark, path)
    if not per_file:
        return require_single_row(df, what=path)
    named = df.withColumn("source_path", F.input_file_name())
    return require_single_row(named, ["source_path"], path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def with_flag(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, parse_flag(F.col(column)))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _behind_mount(spark: SparkSession, root: str) -> str:
    """``root`` by the name of the file system behind a mount, which tasks can open; itself where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(path).toString()
    except Py4JJavaError:  # a pattern or several mounts
        return root


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of every file, named by its path below ``root`` and hashed by the tasks that read them.

    A hash takes a file's bytes in order, so a long file is hashed range by range, each by a task of its
    own that gets the state of the one before. Where tasks cannot open files themselves Spark reads them
    whole. Spark's file reader passes over files without a byte; they are not listed.
    """
    target = _behind_mount(spark, root)
    ranged = digests.can_hash_ranges(target)
    below = (target if ranged else root).split("://")[-1].rstrip("/") + "/"
    name = F.col("path").substr(F.instr("path", below) + F.lit(len(below)), F.length("path")).alias("name")
    if not ranged:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
        return files.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = list_files(spark, target, pattern)
    rows = files.select("path", name, F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    longest = files.agg(F.max("length")).first()[0] or 0
    for start in range(0, longest, digests.RANGE_BYTES):
        rows = rows.mapInArrow(digests.hash_ranges(start, digests.RANGE_BYTES), digests.SCHEMA)
        if start + digests.RANGE_BYTES < longest:
            rows = materialise(rows)  # keeps its partitions: one long file in each
    return rows.select("name", "bytes", "sha256")


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose size or hash differs from the expected manifest, or that are missing."""
    known = expected.select("name", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256"))
    joined = known.join(found, "name", "left")
    same = F.col("bytes").eqNullSafe(F.col("expected_bytes")) & F.col("sha256").eqNullSafe(F.col("expected_sha256"))
    return joined.where(~same)


def locate_one(spark: SparkSession, root: str, pattern: str, required: bool = True, exclude: str | None = None) -> str | None:
    """The single file matching a glob; more than one is an error, none is unless optional."""
    files = list_files(spark, root, pattern)
    if exclude:
        files = files.where(~F.lower(F.element_at(F.split("path", "/"), -1)).contains(exclude.lower()))
    found = [r["path"] for r in files.select("path").orderBy("path").take(2)]
    if len(found) > 1 or (required and not found):
        raise GateError(f"expected one {pattern!r} in {root}, found {len(found)} or more")
    return found[0] if found else None


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Landmark pairs as numbers: moving (x, y) and fixed (u, v)."""
    raw = require_columns(read_text_csv(spark, path), ["landmark_id", "moving_x_px", "moving_y_px", "fixed_x_px", "fixed_y_px"], path)
    names = {"x": "moving_x_px", "y": "moving_y_px", "u": "fixed_x_px", "v": "fixed_y_px"}
    return raw.select("landmark_id", *[F.col(source).cast("double").alias(name) for name, source in names.items()])


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """2-D transform text files (``Parameters:`` and ``FixedParameters:`` lines) as a..d, tx, ty per file.

    Four matrix entries and a translation about a centre of rotation, or scale,
    angle and translation for a similarity.
    """
    text = spark.read.text(path, wholetext=True).withColumn("source_path", F.input_file_name())
    numbers = lambda label: F.transform(
        F.split(F.trim(F.regexp_extract("value", rf"(?m)^{label}:([^\n]*)$", 1)), r"\s+"), lambda v: v.try_cast("double"))
    p, c = F.col("p"), F.col("c")
    parsed = text.select("source_path", numbers("Parameters").alias("p"), numbers("FixedParameters").alias("c"))
    affine = F.size(p) == 6
    scale, angle = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    a = F.when(affine, F.get(p, F.lit(0))).otherwise(scale * F.cos(angle))
    b = F.when(affine, F.get(p, F.lit(1))).otherwise(-scale * F.sin(angle))
    cc = F.when(affine, F.get(p, F.lit(2))).otherwise(scale * F.sin(angle))
    d = F.when(affine, F.get(p, F.lit(3))).otherwise(scale * F.cos(angle))
    tx = F.when(affine, F.get(p, F.lit(4))).otherwise(F.get(p, F.lit(2)))
    ty = F.when(affine, F.get(p, F.lit(5))).otherwise(F.get(p, F.lit(3)))
    x0, y0 = F.coalesce(F.get(c, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(c, F.lit(1)), F.lit(0.0))
    flat = parsed.select("source_path", a.alias("a"), b.alias("b"), cc.alias("c"), d.alias("d"), tx.alias("t0"), ty.alias("t1"), x0.alias("x0"), y0.alias("y0"))
    return flat.select(
        "source_path", "a", "b", "c", "d",
        (F.col("t0") + F.col("x0") - F.col("a") * F.col("x0") - F.col("b") * F.col("y0")).alias("tx"),
        (F.col("t1") + F.col("y0") - F.col("c") * F.col("x0") - F.col("d") * F.col("y0")).alias("ty"))


def notebook_cells(spark: SparkSession, path: str, marker: str = "%%writefile ", prefix: str = "") -> DataFrame:
    """Code cells that write a file: relative target path and body. Absolute or parent paths are left out."""
    schema = "cells array<struct<cell_type:string, source:array<string>>>"
    cells = read_json_documents(spark, path, schema).select(F.explode("cells").alias("cell"))
    code = cells.where(F.col("cell.cell_type") == "code").select(F.array_join("cell.source", "").alias("text"))
    first, body = F.substring_index("text", "\n", 1), F.regexp_replace("text", r"^[^\n]*\n", "")
    target = F.trim(F.substr(first, F.lit(len(marker) + 1)))
    found = code.where(F.col("text").startswith(marker)).select(target.alias("target"), body.alias("body"))
    if prefix:
        found = found.where(F.col("target").startswith(prefix)).withColumn("target", F.substr("target", F.lit(len(prefix) + 1)))
    return found.where(~F.col("target").startswith("/") & ~F.array_contains(F.split("target", "/"), ".."))


def release_scan(texts: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row per (document, forbidden pattern) hit, over whole texts."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return texts.select(key, F.explode(hits).alias("pattern"))


def forbidden_files(files: DataFrame, path: str, suffixes: list[str], names: list[str]) -> DataFrame:
    """(path, rule) of files that a release may not hold: ``suffix`` by their last suffix, whatever its case, ``name`` by their whole name."""
    last = F.element_at(F.split(F.col(path), "/"), -1)
    suffix = F.lower(F.regexp_extract(last, r".(\.[^.]*)$", 1))
    rules = F.array_compact(F.array(F.when(suffix.isin(*suffixes), F.lit("suffix")), F.when(last.isin(*names), F.lit("name"))))
    return files.select(F.col(path).alias("path"), F.explode(rules).alias("rule"))


def safe_extract(archive: str | Path, destination: str | Path) -> list[str]:
    """Unpack a small control archive on the driver; members may not leave the destination."""
    with zipfile.ZipFile(archive) as handle:
        names = handle.namelist()
        unsafe = [n for n in names if PurePosixPath(n).is_absolute() or ".." in PurePosixPath(n).parts]
        if unsafe:
            raise GateError(f"unsafe archive members: {unsafe[:5]}")
        handle.extractall(destination)
    return names


def read_registry(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def first_difference(left: str | Path, right: str | Path, block: int = 1 << 22) -> int | None:
    """Offset of the first differing byte of two control files, or None when they are identical."""
    at = 0
    with open(left, "rb") as a, open(right, "rb") as b:
        while True:
            x, y = a.read(block), b.read(block)
            if x != y:
                return at + next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            if not x:
                return None
            at += len(x)
