"""Near-duplicate vectors by sorted projection passes.

In every pass a vector gets a key of ``KEY_BITS`` random hyperplane signs. All passes are sorted
lexicographically at once, and each vector is compared with the ``WINDOW`` neighbours after it.
A pass also has runs of vectors that agree in the leading ``prefix`` bits. Where a run is longer
than the window, its other pairs are compared too, in pairs of blocks of bounded size, so a
large group of near copies loses no link to the window. The number of passes follows from the
number of vectors and the threshold: a pair at the threshold shares no prefix in any pass with
probability at most ``MISS``.

A pair that shares prefixes is counted in the first such pass only, so link counts are summed
where they are found and pairs are not listed; pairs met in windows alone are few and made distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import components, with_rank

KEY_BITS, WINDOW, BLOCK, MISS = 60, 32, 256, 1e-4
FOUND = "kind int, a long, b long"


def prefix_bits(n: int) -> int:
    """Leading bits that leave about a window of unrelated vectors together."""
    return min(40, max(4, math.ceil(math.log2(max(n, 1) / WINDOW + 1))))


def passes_for(bits: int, threshold: float) -> int:
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - together))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null for a vector that cannot have an angle."""
    for batch in batches:
        out = []
        for value in batch.column(1):
            items = value.as_py()
            unit = None
            if items and None not in items:
                x = np.array(items, float)
                peak = np.abs(x).max()
                if np.isfinite(x).all() and peak > 0:
                    x = x / peak
                    unit = (x / math.sqrt(float(x @ x))).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _keys(passes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low in range(0, len(ids), 512):
                keys = np.empty((len(ids[low : low + 512]), passes), np.int64)
                for i, unit in enumerate(units[low : low + 512]):
                    x = np.frombuffer(unit)
                    if len(x) not in planes:
                        planes[len(x)] = np.random.default_rng([len(x), 23]).normal(size=(len(x), passes * KEY_BITS))
                    keys[i] = ((x @ planes[len(x)]).reshape(passes, KEY_BITS) > 0) @ weights
                heads = (keys >> (KEY_BITS - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low : low + 512], pa.int64()), pa.array(units[low : low + 512], pa.binary()),
                     pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array([h.tobytes() for h in heads], pa.binary())],
                    ["id", "unit", "keys", "heads"])

    return run


def _compared(threshold: float, near: bool):
    """Links in one block: in windows (``near``), or beyond the window within one run."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for (turn, _), part in group.groupby(["turn", group["unit"].map(len)]):
            part = part.sort_values("rank")
            ids, rank, side = part["id"].to_numpy(), part["rank"].to_numpy(), part["side"].to_numpy()
            copies = part["copies"].to_numpy()
            x = np.stack([np.frombuffer(u) for u in part["unit"]])
            heads = np.stack([np.frombuffer(h, np.int64) for h in part["heads"]])
            good = x @ x.T >= threshold
            apart = rank[None, :] - rank[:, None]
            good &= apart > 0
            good &= apart <= WINDOW if near else apart > WINDOW
            if near:
                good &= side[:, None] == 0  # pairs that start in the halo belong to the next block
            elif (side == 1).any():
                good &= side[:, None] != side[None, :]
            i, j = np.nonzero(good)
            together = heads[i] == heads[j]
            first = together.argmax(axis=1)
            any_pass = together.any(axis=1)
            counted = any_pass & (first == turn)
            alone = ~any_pass
            found += [(2, int(a), int(b)) for a, b in zip(ids[i[alone]], ids[j[alone]])]
            i, j = i[counted], j[counted]
            degree = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            found += [(0, int(ids[k]), int(degree[k])) for k in np.flatnonzero(degree)]
            root = np.arange(len(ids))

            def top(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for a, b in zip(i.tolist(), j.tolist()):
                p, q = top(a), top(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((1, int(ids[a]), int(ids[b])))
        return pd.DataFrame(found, columns=["kind", "a", "b"]).astype({"kind": "int32", "a": "int64", "b": "int64"})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Links are pairs with cosine >= threshold in double precision, whatever other columns say.
    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor
    do vectors of different length. Equal vectors are compared once and count as links of each
    other. Ids are unique integers; a row with a null id keeps null ids, no links, and kept =
    true. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    units = materialise(rows.mapInArrow(_units, "vec_id long, unit binary"))
    usable = units.where("vec_id IS NOT NULL AND unit IS NOT NULL")
    classes = materialise(usable.groupBy("unit").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    n = classes.count()
    bits = prefix_bits(n)
    passes = passes_for(bits, threshold)
    keyed = classes.select("id", "unit").mapInArrow(_keys(passes, bits), "id long, unit binary, keys array<long>, heads binary")
    keyed = materialise(keyed.join(classes.select("id", "copies"), "id"))
    order = materialise(keyed.select("id", F.octet_length("unit").alias("width"), F.posexplode("keys").alias("turn", "key")))
    ranked = materialise(with_rank(order, ["turn", "width", "key", "id"]))
    own = F.floor(F.col("rank") / BLOCK)
    into = F.when(F.col("rank") % BLOCK < WINDOW, F.array(own, own - 1)).otherwise(F.array(own))
    near = ranked.withColumn("block", F.explode(into)).withColumn("side", F.when(F.col("block") == own, 0).otherwise(1))
    near = near.select("id", "turn", "rank", "block", "side").join(keyed.select("id", "unit", "heads", "copies"), "id")
    found = near.groupBy("block").applyInPandas(_compared(threshold, True), FOUND)

    head = F.shiftright("key", KEY_BITS - bits)
    runs = ranked.withColumn("head", head)
    long_runs = runs.groupBy("turn", "width", "head").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > WINDOW + 1)
    dealt = runs.join(long_runs, ["turn", "width", "head"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = dealt.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "id", "turn", "rank", "width", "head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")).join(keyed.select("id", "unit", "heads", "copies"), "id")
    found = materialise(found.unionByName(dealt.groupBy("turn", "width", "head", "i", "j").applyInPandas(_compared(threshold, False), FOUND)))

    lone = found.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = found.where("kind = 1").select("a", "b").unionByName(lone)
    return _counted(units, classes, found, lone, edges)


def _counted(units: DataFrame, classes: DataFrame, found: DataFrame, lone: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct links in vectors, not classes: a neighbour class counts with all its copies."""
    ends = lone.unionByName(lone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(classes.select("id", "copies"), F.col("b") == F.col("id")).select("a", F.col("copies").alias("b"))
    degrees = found.where("kind = 0").select("a", "b").unionByName(ends).groupBy("a").agg(F.sum("b").alias("degree"))
    graph = components(edges, "a", "b")
    per_class = classes.join(degrees, F.col("id") == F.col("a"), "left").join(graph, F.col("id") == F.col("node"), "left")
    per_class = per_class.select(
        "unit", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = units.join(per_class, "unit", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
