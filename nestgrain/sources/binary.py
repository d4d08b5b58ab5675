"""NPY matrices and scalar-object pickle streams, read in tasks without unpickling."""

from __future__ import annotations

import math
import pickletools
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import GateError, require_empty
from .tables import list_files

# The stream's payload conventions.
IMAGE_BYTES = 1024 * 1024
SHAPE_WINDOW = 64
CURVES = 5
BINARY_OPS = ("BINBYTES", "BINBYTES8", "SHORT_BINBYTES")
TEXT_OPS = ("BINUNICODE", "BINUNICODE8", "SHORT_BINUNICODE", "UNICODE", "BINSTRING", "SHORT_BINSTRING", "STRING")
INTEGER_OPS = ("BININT", "BININT1", "BININT2")


def _open(path: str):
    """Seekable handle on a local or object-store path, as Spark reports it."""
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    if "://" not in uri:
        uri = "file://" + uri
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _header(handle) -> dict:
    version = npy.read_magic(handle)
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ValueError(f"unsupported NPY version {version}")
    read = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
    shape, fortran, dtype = read(handle)
    return {"shape": [int(n) for n in shape], "dtype": dtype.str, "kind": dtype.kind, "itemsize": dtype.itemsize,
            "fortran": bool(fortran), "offset": handle.tell(), "scalar_object": shape == () and dtype.kind == "O"}


HEADER_SCHEMA = (
    "path string, length bigint, shape array<bigint>, dtype string, kind string, itemsize int, fortran boolean, offset bigint, scalar_object boolean"
)


def npy_headers(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """Shape, type and payload offset per file; only the headers are read."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                with _open(path) as handle:
                    rows.append({"path": path, "length": length, **_header(handle)})
            yield pd.DataFrame(rows)

    return list_files(spark, root, pattern).select("path", "length").mapInPandas(run, HEADER_SCHEMA)


def read_npy_matrix(spark: SparkSession, root: str, pattern: str = "*.npy", rows_per_chunk: int = 65536) -> DataFrame:
    """(path, row_index, values) for numeric matrices and vectors, read as independent row ranges.

    A large file is split over many tasks, which replaces memory mapping. Row index
    is part of the data, so results are joined by key, never by position.
    """
    heads = npy_headers(spark, root, pattern)
    require_empty(heads.where(~F.col("kind").isin("f", "i", "u", "b") | F.col("fortran") | (F.size("shape") < 1) | (F.size("shape") > 2)).select("path"),
                  "not a C-ordered numeric vector or matrix")
    rows = F.get("shape", F.lit(0))
    width = F.when(F.size("shape") == 2, F.get("shape", F.lit(1))).otherwise(F.lit(1))
    last = F.greatest(rows - 1, F.lit(0))
    chunks = heads.where(rows > 0).select(
        "path", "dtype", "offset", width.alias("width"), rows.alias("rows"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(rows_per_chunk).cast("bigint"))).alias("start"))
    spread = chunks.repartition("path", "start")

    def run(batches):
        for pdf in batches:
            for c in pdf.itertuples(index=False):
                kind = np.dtype(c.dtype)
                count = min(rows_per_chunk, c.rows - c.start)
                with _open(c.path) as handle:
                    handle.seek(int(c.offset + c.start * c.width * kind.itemsize))
                    block = np.frombuffer(handle.read(int(count * c.width * kind.itemsize)), dtype=kind).reshape(int(count), int(c.width))
                for at in range(0, len(block), 4096):
                    part = block[at:at + 4096].astype(np.float64)
                    yield pd.DataFrame({"path": c.path, "row_index": np.arange(c.start + at, c.start + at + len(part)), "values": list(part)})

    return spread.mapInPandas(run, "path string, row_index bigint, values array<double>")


def read_borders(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """An integer N x 2 matrix as (grp, start, stop)."""
    heads = npy_headers(spark, root, pattern)
    bad = heads.where(~F.col("kind").isin("i", "u") | (F.size("shape") != 2) | (F.get("shape", F.lit(1)) != 2))
    require_empty(bad.select("path"), "borders must be an integer N x 2 array")
    rows = read_npy_matrix(spark, root, pattern)
    return rows.select(F.col("row_index").alias("grp"), F.get("values", F.lit(0)).cast("bigint").alias("start"), F.get("values", F.lit(1)).cast("bigint").alias("stop"))


def read_names(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """A one-dimensional fixed-width string array as (idx, name)."""
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as handle:
                    head = _header(handle)
                    if head["kind"] not in "US" or len(head["shape"]) != 1:
                        raise GateError(f"{path} is not a one-dimensional string array")
                    names = np.frombuffer(handle.read(), dtype=head["dtype"]).astype(str)
                yield pd.DataFrame({"path": path, "idx": np.arange(len(names)), "name": names})

    return list_files(spark, root, pattern).select("path").mapInPandas(run, "path string, idx bigint, name string")


# ---- pickle streams -------------------------------------------------------------------

def _payload_events(handle) -> Iterator[tuple[str, object, tuple[int, int] | None]]:
    """(opcode, argument, shape) in stream order; shape is set on image-sized byte payloads.

    A payload's shape is the latest (int, int) tuple among the preceding opcodes
    whose product accounts for its 8-byte values.
    """
    seen = 0
    previous: deque = deque(maxlen=2)
    shapes: deque = deque()
    for opcode, argument, _ in pickletools.genops(handle):
        name = opcode.name
        if name in BINARY_OPS:
            shape = None
            if name != "SHORT_BINBYTES" and len(argument) >= IMAGE_BYTES:
                fits = [s for at, s in shapes if seen - at <= SHAPE_WINDOW - 2 and s[0] * s[1] * 8 == len(argument)]
                shape = fits[-1] if fits else None
            yield name, argument, shape
            continue
        if name == "TUPLE2" and len(previous) == 2 and all(op in INTEGER_OPS for op, _ in previous):
            shapes.append((seen, (int(previous[0][1]), int(previous[1][1]))))
            while shapes and seen - shapes[0][0] > SHAPE_WINDOW:
                shapes.popleft()
        previous.append((name, argument))
        seen += 1
        yield name, argument, None


def _stream(path: str):
    handle = _open(path)
    head = _header(handle)
    if not head["scalar_object"]:
        handle.close()
        raise GateError(f"{path} is not a scalar object array")
    return handle, head


def object_stream_audit(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, kind, item, n): opcode, payload-size, image-shape and string counts of each stream, nothing unpickled."""
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                counts: Counter = Counter()
                handle, _ = _stream(path)
                with handle:
                    for name, argument, shape in _payload_events(handle):
                        counts["opcode", name] += 1
                        if name in BINARY_OPS:
                            counts["payload_bytes", str(len(argument))] += 1
                        if shape:
                            counts["image_shape", f"{shape[0]}x{shape[1]}"] += 1
                        if name in TEXT_OPS:
                            counts["text", str(argument)] += 1
                items = sorted(counts.items())
                yield pd.DataFrame({"path": path, "kind": [k for (k, _), _ in items], "item": [i for (_, i), _ in items], "n": [n for _, n in items]})

    return list_files(spark, root, pattern).select("path").mapInPandas(run, "path string, kind string, item string, n bigint")


# Bounds of a plausible curve value, shared by both readings.
LARGEST, SMALLEST = 10000, 1e-100


def scalar_values(payloads: list[bytes]) -> np.ndarray:
    """All eight-byte payloads of a scan at once: read as floats, but as integers where only those are plausible."""
    raw = b"".join(payloads)
    floats, integers = np.frombuffer(raw, "<f8"), np.frombuffer(raw, "<i8")
    size = np.abs(floats)
    plausible = (size <= LARGEST) & ((size >= SMALLEST) | (size == 0))
    return np.where(~plausible & (integers >= -LARGEST) & (integers <= LARGEST), integers, floats)


def _scans(handle) -> Iterator[tuple[int, tuple[int, int], bytes, np.ndarray]]:
    """(index, shape, image bytes, scalar values that follow it) per scan, one scan in memory at a time."""
    current, values = None, []
    index = -1
    for name, argument, shape in _payload_events(handle):
        if shape:
            if current:
                yield index, *current, scalar_values(values)
            index, current, values = index + 1, (shape, argument), []
        elif current and name == "SHORT_BINBYTES" and len(argument) == 8:
            values.append(argument)
    if current:
        yield index, *current, scalar_values(values)


def read_curves(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, scan, curve, values) boundary curves; a scan without five complete curves is an error."""
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                handle, _ = _stream(path)
                with handle:
                    for index, (_, width), _, values in _scans(handle):
                        if len(values) != CURVES * width:
                            raise GateError(f"{path} scan {index}: {len(values)} curve values, expected {CURVES * width}")
                        yield pd.DataFrame({"path": path, "scan": index, "curve": range(CURVES), "values": list(np.asarray(values).reshape(CURVES, width))})

    return list_files(spark, root, pattern).select("path").mapInPandas(run, "path string, scan bigint, curve int, values array<double>")


def read_image_fingerprints(spark: SparkSession, root: str, pattern: str, stride: int) -> DataFrame:
    """(path, scan, height, width, fingerprint): strided z-scores of each scan's image."""
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                handle, _ = _stream(path)
                with handle:
                    for index, shape, raw, _ in _scans(handle):
                        sample = np.frombuffer(raw, "<f8").reshape(shape)[::stride, ::stride].astype(np.float64).ravel()
                        sd = sample.std()
                        z = (sample - sample.mean()) / sd if math.isfinite(sd) and sd > 0 else np.zeros_like(sample)
                        yield pd.DataFrame({"path": [path], "scan": [index], "height": [shape[0]], "width": [shape[1]], "fingerprint": [z]})

    return list_files(spark, root, pattern).select("path").mapInPandas(
        run, "path string, scan bigint, height int, width int, fingerprint array<double>")


def read_images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """(path, height, width, pixels) greyscale rasters decoded by Spark's image source; a file that is no image is an error."""
    images = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    grey = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.height <= 0 or row.width <= 0:
                    raise GateError(f"{row.origin} is not an image that can be decoded")
                data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(float)
                # stored blue-green-red; luma weights 299/587/114 in whole numbers
                level = data[..., 0] if row.nChannels == 1 else np.floor((data[..., 2] * 299 + data[..., 1] * 587 + data[..., 0] * 114) / 1000 + 0.5)
                out.append({"path": row.origin, "height": row.height, "width": row.width, "pixels": level.ravel()})
            yield pd.DataFrame(out, columns=["path", "height", "width", "pixels"])

    return grey.mapInPandas(run, "path string, height int, width int, pixels array<double>")


# ---- curve semantics --------------------------------------------------------------------

def curve_checks(curves: DataFrame, height: int) -> DataFrame:
    """Per scan set: integer rows, rows inside the image, ordering violations, missing and negative counts by curve."""
    spots = curves.select("path", "scan", "curve", F.posexplode("values").alias("x", "v"))
    spots = spots.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    usable = F.col("v").isNotNull() & (F.col("v") >= 0) & (F.col("v") < height)
    marked = spots.withColumn("ok", usable)
    below = marked.select("path", "scan", (F.col("curve") - 1).alias("curve"), "x", F.col("v").alias("next"), F.col("ok").alias("next_ok"))
    paired = marked.join(below, ["path", "scan", "curve", "x"], "left")
    return paired.groupBy("path", "curve").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v") < 0).alias("negative"),
        F.count_if((F.col("v") >= 0) & (F.abs(F.col("v") - F.rint("v")) > 1e-8 + 1e-5 * F.abs("v"))).alias("non_integer"),
        F.count_if(F.col("v") >= height).alias("outside"),
        F.count_if(F.coalesce(F.col("ok") & F.col("next_ok") & (F.col("next") < F.col("v")), F.lit(False))).alias("order_violations"))


def difference_checks(curves: DataFrame, derived: DataFrame, height: int) -> DataFrame:
    """Compare a derived table with successive curve differences: value mismatches, missingness mismatches, bottom curve."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("scan", "curve", F.posexplode("values").alias("x", name)).withColumn(name, F.when(~F.isnan(name), F.col(name)))

    base = long(curves, "v")
    lower = base.select("scan", (F.col("curve") - 1).alias("curve"), "x", F.col("v").alias("below"))
    joined = base.join(lower, ["scan", "curve", "x"], "left").join(long(derived, "d"), ["scan", "curve", "x"])
    bottom = F.col("curve") == CURVES - 1
    gap = F.col("below") - F.col("v")
    inside = (F.col("v") >= 0) & (F.col("v") < height) & (F.col("below") >= 0) & (F.col("below") < height)
    observed = ~bottom & inside & (F.col("d") >= 0)
    return joined.agg(
        F.count_if(F.coalesce(observed & (F.col("d") != gap), F.lit(False))).alias("value_mismatches"),
        F.count_if(~bottom & (F.col("d").isNull() != gap.isNull())).alias("missingness_mismatches"),
        F.count_if(bottom & ~F.col("d").eqNullSafe(F.col("v"))).alias("bottom_mismatches"))
