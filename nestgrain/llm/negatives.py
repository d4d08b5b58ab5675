"""Hard negatives through a multiway hyperplane tree with distance ranges.

Scores are integer inner products. One more coordinate, sqrt(M² - |x|²) with M the largest norm,
puts every row on a sphere, where the distance to an anchor (whose extra coordinate is 0) falls as
the score grows: a window of scores is an annulus around the anchor.

The tree has ``ARITY`` split points a node, chosen far apart from a sample of at most ``SAMPLE``
rows; a row belongs to its nearest split point. Over all rows, every split point stores the range
of its distances to each sibling's subtree. A sibling is out when, for any split point, the range
widened by the anchor's distance to that point misses the annulus. Subtrees that stay are compared
row by row in exact integers, so the sample only shapes the tree. The sample, being rows, also
gives each search a score that its last place cannot fall below.

Leaves are cut into tiles of bounded size and anchors into blocks, so a task meets one tile and
one block, and a vector that fills a leaf with its copies is spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

ARITY, LEVELS, SAMPLE = 8, 2, 4096
TILES, LEAST_TILE, LARGEST_TILE = 128, 512, 65_536  # rows a tile: all rows / TILES within these limits
ANCHOR_BLOCK = 32_768
STEP_CELLS = 1 << 22  # scores held at once
NO_SCORE = -(1 << 62)
KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def _coded(scale: float):
    """Components as floor(scale·x) in the narrowest integer type; rows with a null or non-finite component have no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, dims, squares = [], [], []
            for value in batch.column(2):
                items = value.as_py()
                code = dim = square = None
                if items is not None and None not in items:
                    x = np.array(items, float)
                    if np.isfinite(x).all():
                        q = np.floor(scale * x)
                        square = float(q @ q)
                        if square >= 2.0**62:
                            raise OverflowError("scores of a vector this long pass 64 bits")
                        top = np.abs(q).max(initial=0)
                        code = q.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes()
                        dim = len(q)
                codes.append(code)
                dims.append(dim)
                squares.append(square)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(squares, pa.float64())],
                ["vec_id", "label", "dim", "code", "square"])

    return run


def vectors_of(codes, dim: int) -> np.ndarray:
    """Rows of one dimension as int64."""
    out = np.zeros((len(codes), dim), np.int64)
    if dim:
        for i, code in enumerate(codes):
            out[i] = np.frombuffer(code, KINDS[len(code) // dim])
    return out


def inner(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Exact integer products: through doubles where no partial sum passes 2**53 (all are below the largest square)."""
    if square < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Node(NamedTuple):
    key: int
    points: np.ndarray  # split points with the extra coordinate
    children: list  # Node or None for a leaf, in the order of points
    first_leaf: int
    leaves: int  # under each child


def lifted(vectors: np.ndarray, radius_square: float) -> np.ndarray:
    x = vectors.astype(float)
    extra = np.sqrt(np.maximum(radius_square - (x * x).sum(axis=1), 0))
    return np.column_stack([x, extra])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * x @ points.T
    return np.sqrt(np.maximum(square, 0))


def build(sample: np.ndarray, arity: int = ARITY, levels: int = LEVELS) -> Node | None:
    """A tree over lifted sample rows; split points are far apart, the first one is the row farthest from the mean."""
    count = [0]

    def grow(rows: np.ndarray, level: int, first_leaf: int) -> Node | None:
        if not level or not len(rows):
            return None
        key = count[0]
        count[0] += 1
        away = distances(rows, rows.mean(axis=0)[None, :])[:, 0]
        chosen = [int(away.argmax())]
        near = distances(rows, rows[chosen])[:, 0]
        while len(chosen) < arity and near.max() > 1e-6 * (1 + np.abs(rows).max()):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
        points = rows[chosen]
        under = arity ** (level - 1)
        owner = distances(rows, points).argmin(axis=1)
        children = [grow(rows[owner == j], level - 1, first_leaf + j * under) for j in range(len(points))]
        return Node(key, points, children, first_leaf, under)

    return grow(sample, levels, 0)


def leaf_of(tree: Node | None, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
    """Leaf of every lifted row; with ``ranges`` also widens (node -> lowest, highest distance of point i to subtree j)."""
    out = np.zeros(len(x), np.int64)

    def down(node: Node | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        d = distances(x[rows], node.points)
        owner = d.argmin(axis=1)
        out[rows] = node.first_leaf + owner * node.leaves
        for j, child in enumerate(node.children):
            own = rows[owner == j]
            if len(own) and ranges is not None:
                low, high = ranges.setdefault(node.key, (np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)))
                low[:, j] = np.minimum(low[:, j], d[owner == j].min(axis=0))
                high[:, j] = np.maximum(high[:, j], d[owner == j].max(axis=0))
            down(child, own)

    down(tree, np.arange(len(x)))
    return out


def leaves_met(tree: Node | None, ranges: dict, anchors: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> list[tuple[int, int]]:
    """(row of ``anchors``, leaf) for every subtree whose ranges meet the annulus [near, far] around the anchor."""
    if tree is None:
        return [(i, 0) for i in range(len(anchors))]
    met: list[tuple[int, int]] = []

    def down(node: Node, rows: np.ndarray) -> None:
        if node.key not in ranges or not len(rows):
            return
        low, high = ranges[node.key]
        d = distances(anchors[rows], node.points)[:, :, None]
        reach = (d + high).min(axis=1)  # no row of subtree j is farther
        least = np.maximum(d - high, low - d).max(axis=1)  # nor nearer
        stays = (reach >= near[rows, None] - slack) & (least <= far[rows, None] + slack)
        for j, child in enumerate(node.children):
            own = rows[stays[:, j]]
            if child is not None:
                down(child, own)
            else:
                met.extend((int(i), node.first_leaf + j * node.leaves) for i in own)

    down(tree, np.arange(len(anchors)))
    return met


def _annulus(a: np.ndarray, low: np.ndarray, high: np.ndarray, radius_square: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances on the sphere that scores low..high of these anchors stand for."""
    base = (a.astype(float) ** 2).sum(axis=1) + radius_square
    return np.sqrt(np.maximum(base - 2.0 * high, 0)), np.sqrt(np.maximum(base - 2.0 * low, 0))


def _firsts(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n``: higher scores first, then smaller ids."""
    if len(scores) > 4 * n + 64:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Shape(NamedTuple):
    """What every task knows: trees by dimension, their ranges, the largest square, and the sample."""

    trees: dict
    ranges: dict
    squares: dict
    sample: dict  # dimension -> (ids, labels, vectors)


def _leaves(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            codes = batch.column(3).to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                leaf[rows] = leaf_of(shape.trees.get(dim), lifted(vectors_of([codes[r] for r in rows], dim), shape.squares[dim]))
            yield pa.RecordBatch.from_arrays(batch.columns[:4] + [pa.array(leaf)], ["vec_id", "label", "dim", "code", "leaf"])

    return run


def _ranges(shape: Shape):
    """Ranges of the rows of one task: (dim, node, i, j, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict] = {}
        for batch in batches:
            dims, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                leaf_of(shape.trees.get(dim), lifted(vectors_of([codes[r] for r in rows], dim), shape.squares[dim]), found.setdefault(dim, {}))
        rows = [(dim, key, i, j, low[i, j], high[i, j]) for dim, nodes in found.items() for key, (low, high) in nodes.items()
                for i in range(len(low)) for j in range(len(low)) if high[i, j] >= low[i, j]]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "node", "i", "j", "low", "high"])

    return run


def _index(rows: DataFrame) -> tuple[DataFrame, Shape]:
    """Rows with their leaf, and the shape; the driver holds the sample, the trees and one range for each pair of siblings."""
    squares = {r["dim"]: r["m"] for r in rows.groupBy("dim").agg(F.max("square").alias("m")).collect()}
    drawn = rows.select("vec_id", "label", "dim", "code", F.xxhash64("vec_id", "code").alias("turn")).orderBy("turn", "vec_id").limit(SAMPLE).collect()
    trees, sample = {}, {}
    for dim in {r["dim"] for r in drawn}:
        own = [r for r in drawn if r["dim"] == dim]
        vectors = vectors_of([r["code"] for r in own], dim)
        sample[dim] = (np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), vectors)
        trees[dim] = build(lifted(vectors, squares[dim]))
    shape = Shape(trees, {}, squares, sample)
    index = materialise(rows.mapInArrow(_leaves(shape), "vec_id long, label long, dim int, code binary, leaf long"))
    found = index.select("dim", "code").mapInArrow(_ranges(shape), "dim int, node long, i int, j int, low double, high double")
    split = {(dim, node.key): len(node.points) for dim, tree in trees.items() for node in _nodes(tree)}
    for r in found.groupBy("dim", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        n = split[r["dim"], r["node"]]
        low, high = shape.ranges.setdefault(r["dim"], {}).setdefault(r["node"], (np.full((n, n), np.inf), np.full((n, n), -np.inf)))
        low[r["i"], r["j"]], high[r["i"], r["j"]] = r["low"], r["high"]
    return index, shape


def _nodes(tree: Node | None) -> Iterator[Node]:
    if tree is not None:
        yield tree
        for child in tree.children:
            yield from _nodes(child)


def _routed(shape: Shape, keep: int, windows: bool):
    """(anchor row, leaf) for every leaf that may hold an answer; ``low`` is the least score that still counts, by window.

    Without windows: the anchor's ``keep`` first rows of its own label. With windows: scores low..high for
    each positive, ``keep`` of them, among rows of other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out = {k: [] for k in ("vec_id", "label", "dim", "code", "low", "high", "leaf")}
            for dim in set(rows["dim"]):
                own = [i for i, d in enumerate(rows["dim"]) if d == dim]
                a = vectors_of([rows["code"][i] for i in own], dim)
                square = shape.squares[dim]
                lows = [list(rows["low"][i]) if windows else [NO_SCORE] for i in own]
                highs = [list(rows["high"][i]) if windows else [-NO_SCORE] for i in own]
                if dim in shape.sample:
                    ids, labels, vectors = shape.sample[dim]
                    for at in range(0, len(own), 512):
                        scores = inner(a[at : at + 512], vectors, square)
                        for k, row in enumerate(scores, at):
                            i = own[k]
                            fit = (labels != rows["label"][i]) if windows else (labels == rows["label"][i]) & (ids != rows["vec_id"][i])
                            for w, (low, high) in enumerate(zip(lows[k], highs[k])):
                                inside = row[fit & (row >= low) & (row <= high)]
                                if len(inside) >= keep:
                                    lows[k][w] = int(np.partition(inside, len(inside) - keep)[len(inside) - keep])
                x = np.column_stack([a.astype(float), np.zeros(len(a))])
                spread = [(k, w) for k in range(len(own)) for w in range(len(lows[k]))]
                near, far = _annulus(a[[k for k, _ in spread]], np.array([float(max(lows[k][w], -square)) for k, w in spread]),
                                     np.array([float(min(highs[k][w], square)) for k, w in spread]), square)
                met = leaves_met(shape.trees.get(dim), shape.ranges.get(dim, {}), x[[k for k, _ in spread]], near, far, 1e-6 * (1 + square**0.5))
                for k, leaf in sorted({(spread[s][0], leaf) for s, leaf in met}):
                    i = own[k]
                    for name in ("vec_id", "label", "dim", "code"):
                        out[name].append(rows[name][i])
                    out["low"].append(lows[k])
                    out["high"].append(highs[k])
                    out["leaf"].append(leaf)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def _compared(squares: dict, keep: int, windows: bool):
    """The ``keep`` first rows of one tile for every anchor (and window) of one block, in exact integers."""

    def run(key: tuple, anchors: pa.Table, tile: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = vectors_of(tile.column("code").to_pylist(), dim)
        ids, labels = tile.column("vec_id").to_numpy(), tile.column("label").to_numpy()
        found: list[tuple[int, int, int, int]] = []
        step = max(1, STEP_CELLS // max(len(ids), 1))
        for at in range(0, anchors.num_rows if len(ids) else 0, step):
            rows = anchors.slice(at, step).to_pydict()
            scores = inner(vectors_of(rows["code"], dim), x, squares[dim])
            for row, anchor, label, lows, highs in zip(scores, rows["vec_id"], rows["label"], rows["low"], rows["high"]):
                fit = np.flatnonzero(((labels != label) if windows else (labels == label) & (ids != anchor)) & (row >= min(lows)) & (row <= max(highs)))
                for w, (low, high) in enumerate(zip(lows, highs)):
                    inside = fit[(row[fit] >= low) & (row[fit] <= high)]
                    for place in inside[_firsts(row[inside], ids[inside], keep)]:
                        found.append((anchor, w, int(ids[place]), int(row[place])))
        columns = list(zip(*found)) or [()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("anchor_id", "place", "other_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

    return run


def _searched(index: DataFrame, shape: Shape, tile_rows: int, anchors: DataFrame, blocks: int, keep: int, windows: bool) -> DataFrame:
    """(anchor_id, place, other_id, score): the first ``keep`` answers of every anchor and window over all tiles."""
    routed = anchors.mapInArrow(
        _routed(shape, keep, windows), "vec_id long, label long, dim int, code binary, low array<long>, high array<long>, leaf long")
    sizes = index.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))  # a row a leaf
    sizes = F.broadcast(sizes)
    tiles = index.join(sizes, ["dim", "leaf"]).withColumn("tile", F.pmod(F.xxhash64("vec_id", "code"), F.col("tiles")).cast("int")).drop("tiles")
    tiles = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    routed = routed.join(sizes, ["dim", "leaf"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    keys = ["dim", "leaf", "tile", "block"]
    found = routed.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(
        _compared(shape.squares, keep, windows), "anchor_id long, place int, other_id long, score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: float = 256.0,
                   least: int = 50, most: int = 95, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of the same label; for each, its first
    ``negatives`` rows of other labels with least·p <= 100·score <= most·p follow. Order: higher score, then
    smaller id. ``is_anchor`` is a condition on the id column. Rows with a null id, label or vector, or a
    vector with a null or non-finite component, take no part; vectors of different length never meet
    (empty ones score 0 with each other). Ids are unique; of anchors with one id the smallest (label,
    vector) searches, and a row is never its own id's positive. Fewer rows give fewer answers, an empty
    table none; other columns play no part. A vector whose scores could pass 64 bits is an error.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_column).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                       F.col(vector_column).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    coded = materialise(kept.mapInArrow(_coded(scale), "vec_id long, label long, dim int, code binary, square double").where("code IS NOT NULL"))
    index, shape = _index(coded)
    n = coded.count()
    tile_rows = min(LARGEST_TILE, max(LEAST_TILE, n // TILES))
    name = F.col("vec_id").alias(id_column)
    anchors = coded.select("*", name).where(is_anchor) if id_column != "vec_id" else coded.where(is_anchor)
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "code")).alias("own")).select("vec_id", "own.*")
    anchors = materialise(anchors)
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    empty = F.array().cast("array<long>")
    found = materialise(_searched(index, shape, tile_rows, anchors.select("*", empty.alias("low"), empty.alias("high")), blocks, positives, False))

    chosen = found.where("score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other_id").alias("positive_id"), F.col("score").alias("p")))).alias("chosen"))
    windows = anchors.join(chosen, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "dim", "code",
        F.expr(f"transform(chosen, c -> (CAST({least} AS DECIMAL(20, 0)) * c.p + 99) div 100)").alias("low"), F.expr(f"transform(chosen, c -> (CAST({most} AS DECIMAL(20, 0)) * c.p) div 100)").alias("high"))
    answers = _searched(index, shape, tile_rows, windows, blocks, negatives, True)
    pairs = chosen.select("anchor_id", F.posexplode("chosen").alias("place", "c")).select("anchor_id", "place", "c.positive_id", F.col("c.p").alias("positive_score"))
    return answers.join(pairs, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
