"""Stage fingerprints, the reuse policy and run records.

A stage's data live in a parquet folder; this module only decides on the driver
whether they may be reused. The sidecar binds a fingerprint of inputs and
parameters to the file listing and the row contents that were published. Folders and
sidecars go through the Hadoop file system, so the root may be any URI that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import GateError
from ..sources.tables import list_files

MODES = ("auto", "reuse", "rebuild")


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as handle:
        while chunk := handle.read(block):
            digest.update(chunk)
    return digest.hexdigest()


def fingerprint(parameters: dict, inputs: dict[str, str] | None = None) -> str:
    """sha256 over sorted parameters and (input name, content hash) pairs."""
    text = json.dumps({"parameters": parameters, "inputs": sorted((inputs or {}).items())}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def listing_digest(spark: SparkSession, path: str) -> str:
    """Order-free digest of a folder's data files (relative name and size), computed by Spark from the listing."""
    files = list_files(spark, path, "*.parquet").select(F.concat_ws(
        "|", F.regexp_extract("path", r"([^/]+=[^/]+/)*[^/]+$", 0), F.col("length").cast("string")).alias("line"))
    total = files.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha2(F.col("line").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{total['n']}:{total['s']}"


def _row_sums(df: DataFrame) -> list[Column]:
    columns = [F.to_json(f"`{name}`") if "map<" in kind else F.col(f"`{name}`") for name, kind in df.dtypes]
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")]


def content_digest(df: DataFrame) -> str:
    """Order-free digest of all rows: their number and the exact sum of their 64-bit hashes."""
    found = df.agg(*_row_sums(df)).first()
    return f"{found['n']}:{found['s']}"


def write_observed(df: DataFrame, path: str) -> str:
    """Writes ``df`` and returns its content digest, taken from the rows as they pass: nothing is read a second time."""
    seen = Observation()
    df.observe(seen, *_row_sums(df)).write.mode("overwrite").parquet(path)
    return f"{seen.get['n']}:{seen.get['s']}"


class StageStore:
    """Run a stage once per fingerprint: ``auto`` reuses or builds, ``reuse`` must find it, ``rebuild`` always builds.

    ``root`` is a URI, or a ``Path`` for a folder on this machine.
    """

    def __init__(self, spark: SparkSession, root: str | Path, mode: str = "auto"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.given, self.mode = spark, root, mode
        self.root = root.resolve().as_uri() if isinstance(root, Path) else root.rstrip("/")
        self.records: list[dict] = []

    def _at(self, name: str):
        """The Hadoop file system and path of a name below the root."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _write_control(self, name: str, fields: dict) -> None:
        """A small JSON file; a torn write leaves no readable JSON and so nothing to reuse."""
        system, path = self._at(name)
        stream = system.create(path, True)
        stream.write(bytearray(json.dumps(fields, indent=2, sort_keys=True, default=str) + "\n", "utf-8"))
        stream.close()

    def _read_control(self, name: str) -> dict | None:
        system, path = self._at(name)
        if not system.exists(path):
            return None
        row = self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()
        try:
            found = json.loads(row[0]) if row else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def restore(self, stage: str, mark: str) -> DataFrame | None:
        """The stored table when id, fingerprint, file listing and row contents all agree, else None."""
        saved = self._read_control(f"{stage}.json")
        if saved is None or saved.get("stage") != stage or saved.get("fingerprint") != mark or not saved.get("folder"):
            return None
        system, path = self._at(saved["folder"])
        folder = f"{self.root}/{saved['folder']}"
        if not system.exists(path) or listing_digest(self.spark, folder) != saved.get("listing"):
            return None
        try:
            df = self.spark.read.parquet(folder)
            return df if content_digest(df) == saved.get("content") else None
        except (PySparkException, Py4JJavaError) as error:  # a damaged file: say so and build anew
            warnings.warn(f"stage {stage} cannot be read back: {str(error)[:200]}", stacklevel=2)
            return None

    def run(self, stage: str, mark: str, build: Callable[[], DataFrame], gate: Callable[[DataFrame], dict[str, bool]] | None = None) -> DataFrame:
        if self.mode != "rebuild":
            found = self.restore(stage, mark)
            if found is not None:
                self.records.append({"stage": stage, "action": "reused", "fingerprint": mark})
                return found
            if self.mode == "reuse":
                raise GateError(f"stage {stage} has no reusable output for this fingerprint")
        # a folder per fingerprint: readers of an older version are never disturbed
        folder = f"{stage}-{mark[:16]}"
        content = write_observed(build(), f"{self.root}/{folder}")
        df = self.spark.read.parquet(f"{self.root}/{folder}")
        checks = gate(df) if gate else {}
        failed = [name for name, passed in checks.items() if not passed]
        if failed:
            raise GateError(f"{stage} failed: {failed}")
        self._write_control(f"{stage}.json", {
            "stage": stage, "fingerprint": mark, "folder": folder, "listing": listing_digest(self.spark, f"{self.root}/{folder}"),
            "content": content, "checks": checks})
        self.records.append({"stage": stage, "action": "built", "fingerprint": mark, "checks": checks})
        return df

    def finish(self) -> str | Path:
        """Write the run's records; returns where, in the form the root was given in."""
        self._write_control("run_manifest.json", {"stages": self.records, "mode": self.mode})
        return self.given / "run_manifest.json" if isinstance(self.given, Path) else f"{self.root}/run_manifest.json"
