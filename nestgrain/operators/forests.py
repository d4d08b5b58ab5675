"""Random forests of nested grouped cross-validation, all trees grown together.

Features are binned once into bytes. A level of every tree of every forest (outer fold, inner
fold, leaf size) that has nodes above ``NODE_ROWS`` rows is one keyed aggregation of histograms,
and only the chosen splits come back. A node at or below that size is grown to its leaves by one
task. A table at or below it goes whole to a fixed number of tasks, which share out all trees, so
what is shuffled grows with the table and not with the trees. Depth limits cost nothing: a
shallow forest is the deep one cut at its depth, because every node's features and every tree's
rows follow from hashes of (seed, tree, node) and (seed, tree, row) alone. For the same reason
forests that differ only in their leaf size share every node down to the first split that differs.

Held-out rows travel with the rows they are judged by, so trees never leave the tasks: what comes
out is each held-out row's sum of leaf values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS, MISSING = 64, 255
NODE_ROWS, NODE_BYTES, ROW_BYTES = 100_000, 128 << 20, 64  # a node that one task grows alone: these rows, or as many as fit these bytes
SHARES = 4  # tasks a core that share out the trees of a table that fits one
SAMPLES = 250_000  # (tree, row) pairs held at once
COLUMNS, CELLS = 2048, 1 << 16  # (node, feature) histograms and (row, feature) cells worked on at once
PACK, APART = 2.0**26, 1.5 * 2.0**78  # rows * PACK + drawn rows is one exact number; adding and taking off APART leaves rows * PACK
SHIFT = BINS.bit_length() - 1  # a split is feature << SHIFT | last bin on the left
CHUNK_ROWS = 10_000  # rows of a table packed into one record
U64 = np.uint64
BAG = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])  # Poisson with mean 1


class Forest(NamedTuple):
    """One forest: the training set (outer position, inner fold left out or 0), its leaf size and trees."""

    number: int
    outer: int
    left_out: int
    leaf: int
    trees: int
    seed: int


class Shape(NamedTuple):
    features: int
    tried: int  # features a node may split on
    cuts: tuple  # depth limits to read off, None for none
    fills: dict  # (outer, left out) -> {column: bin of the training median}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tree_roots(forest: Forest, trees: np.ndarray) -> np.ndarray:
    return mix(mix(np.full(len(trees), forest.seed, U64) + U64(0x9E3779B97F4A7C15)) + trees.astype(U64))


def bag(turns: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """(trees, rows) times that a row is drawn."""
    u = (mix(turns[None, :] ^ mix(roots)[:, None]) >> U64(11)) * 2.0**-53
    return np.searchsorted(BAG, u.ravel(), "right").reshape(u.shape)


def node_features(nodes: np.ndarray, features: int, tried: int) -> np.ndarray:
    if tried >= features:
        return np.tile(np.arange(features), (len(nodes), 1))
    turn = mix(nodes[:, None] + mix(np.arange(1, features + 1, dtype=U64))[None, :])
    return np.argpartition(turn, tried - 1, axis=1)[:, :tried]


def children(nodes: np.ndarray, side: np.ndarray) -> np.ndarray:
    return mix(nodes * U64(2) + side.astype(U64) + U64(1))


def histograms(node: np.ndarray, bins: np.ndarray, w: np.ndarray, y: np.ndarray, n_nodes: int) -> np.ndarray:
    """(3, nodes, tried features, bins): rows, drawn rows and their sums of y."""
    tried = bins.shape[1]
    key = ((node[:, None] * tried + np.arange(tried)) * BINS + bins).ravel()
    size = n_nodes * tried * BINS
    parts = [np.bincount(key, minlength=size), np.bincount(key, np.repeat(w, tried), size), np.bincount(key, np.repeat(w * y, tried), size)]
    return np.stack(parts).reshape(3, n_nodes, tried, BINS).astype(float)


def best_splits(hist: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tried feature, last bin on the left, may split) of every node: the largest fall of the squared error."""
    left = hist.cumsum(axis=3)
    total = left[..., -1:]
    left = left[..., :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - total[2] ** 2 / total[1]
    gain = np.where((left[0] >= leaf) & (right[0] >= leaf), gain, -np.inf).reshape(hist.shape[1], -1)
    best = gain.argmax(axis=1)
    worth = gain[np.arange(len(best)), best] > 1e-12 * (1.0 + total[2, :, 0, 0] ** 2 / np.maximum(total[1, :, 0, 0], 1))
    return best // (BINS - 1), best % (BINS - 1), worth


def _apart(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = packed + APART
    high -= APART
    return high * (1 / PACK), packed - high


def _falls(packed: np.ndarray, s: np.ndarray, all_drawn: np.ndarray, all_s: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Fall of the squared error from the rows on the left and their sum of y; in few passes, as it takes most of the time."""
    with np.errstate(divide="ignore", invalid="ignore"):
        drawn = packed + APART
        drawn -= APART
        np.subtract(packed, drawn, drawn)
        fall = s * s
        fall /= drawn
        np.subtract(all_drawn, drawn, drawn)
        right = all_s - s
        right *= right
        right /= drawn
        fall += right
        fall -= base
    return fall


def _best(cells: np.ndarray, off: np.ndarray, packed: np.ndarray, wy: np.ndarray, count: np.ndarray, tried: np.ndarray, leaves: list[int]) -> list[tuple]:
    """What ``best_splits`` finds, for every leaf size: rows come node by node, bins in lines of all (feature, node)."""
    n, width = tried.shape
    step = max(1, min(width, CELLS // len(off)))
    found: list = [None] * len(leaves)
    node = np.arange(n)
    for first in range(0, width, step):
        some = tried.T[first : first + step]
        size = len(some) * n
        line = size + 9  # lines a power of two apart would share cache sets
        key = np.repeat(some, count, axis=1)
        key += off
        np.multiply(cells.take(key, mode="wrap"), line, out=key, dtype=np.int64)
        key += np.repeat(np.arange(size).reshape(-1, n), count, axis=1)
        p, s = (np.bincount(key.ravel(), np.tile(v, len(some)), BINS * line).reshape(BINS, line) for v in (packed, wy))
        for hist in (p, s):
            left = hist[0]
            for row in hist[1:]:
                left = np.add(row, left, row)
        all_p, all_s, p, s = p[-1], s[-1], p[:-1], s[:-1]
        all_drawn = _apart(all_p)[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            base = all_s * all_s / all_drawn
        if not first:
            least = 1e-12 * (1.0 + base[:n])
        fewer = np.minimum(p, all_p - p)  # of the two sides
        allowed = fewer >= leaves[0] * PACK
        sparse = 4 * np.count_nonzero(allowed) < allowed.size
        if sparse:
            at = np.flatnonzero(allowed)
            column = at % line
            fall = np.full(p.shape, -np.inf)
            fall.ravel()[at] = _falls(p.ravel().take(at), s.ravel().take(at), all_drawn.take(column), all_s.take(column), base.take(column))
        else:
            fall = _falls(p, s, all_drawn, all_s, base)
        for k, leaf in enumerate(leaves):
            if k or not sparse:
                bound = fewer - (leaf * PACK - 0.5)
                bound *= np.inf  # by its sign; faster than a mask
                np.fmin(fall, bound, fall)
            top = fall.max(axis=0)[:size].reshape(-1, n)
            slot = top.argmax(axis=0)
            new = slot + first, fall.take(slot * n + node, axis=1).argmax(axis=0), top[slot, node]
            found[k] = new if found[k] is None else [np.where(new[2] > found[k][2], a, b) for a, b in zip(new, found[k])]
    return [(slot, last, fall > least) for slot, last, fall in found]


class _Front(NamedTuple):
    """Nodes that may split and, node by node, their drawn rows: offset into the cells, rows and drawn rows packed, sum of y."""

    ids: np.ndarray
    nodes: np.ndarray
    live: np.ndarray  # (leaf sizes, nodes) that may split
    count: np.ndarray
    off: np.ndarray
    packed: np.ndarray
    wy: np.ndarray


def _front(first: int, nodes, own: np.ndarray, owner: np.ndarray, size: np.ndarray, leaves: list[int], off: np.ndarray, packed: np.ndarray, wy: np.ndarray) -> _Front:
    """Of the nodes numbered from ``first`` those that may split, with their rows; left and right ones apart, so that only bytes are sorted."""
    live = own & (size >= 2 * np.array(leaves)[:, None])
    kind = (2 * (len(leaves) - live.sum(axis=0)) + (np.arange(len(size)) & 1)).astype(np.uint8)
    node = np.argsort(kind, kind="stable")[: np.count_nonzero(live.any(axis=0))]
    count = size[node].astype(np.int64)
    rows = np.argsort(kind.take(owner), kind="stable")[: count.sum()]
    return _Front(first + node, nodes(node), live[:, node], count, off.take(rows), packed.take(rows), wy.take(rows))


def _chosen(cells: np.ndarray, front: _Front, tried: np.ndarray, leaves: list[int]) -> np.ndarray:
    """(leaf sizes, nodes) splits, -1 for none, some nodes at a time."""
    n, width = tried.shape
    out = np.full((len(leaves), n), -1)
    ends = np.cumsum(front.count)
    first = 0
    while first < n:
        low = ends[first] - front.count[first]
        full = int(np.searchsorted(ends, low + CELLS // width, "right"))
        stop = min(n, first + max(1, COLUMNS // width), max(first + 1, full))
        rows, some, live = slice(low, ends[stop - 1]), tried[first:stop], front.live[:, first:stop]
        own = np.flatnonzero(live.any(axis=1))
        found = _best(cells, front.off[rows], front.packed[rows], front.wy[rows], front.count[first:stop], some, [leaves[k] for k in own])
        for k, (slot, last, worth) in zip(own, found):
            out[k, first:stop] = np.where(worth & live[k], (some[np.arange(len(some)), slot] << SHIFT) + last, -1)
        first = stop
    return out


def _right(cells: np.ndarray, off: np.ndarray, split: np.ndarray) -> np.ndarray:
    return cells.take(off + (split >> SHIFT), mode="wrap") > (split & (BINS - 1))


def grow(data: dict, leaves: list[int], shape: Shape, roots: np.ndarray, draws: np.ndarray, depth: int) -> np.ndarray:
    """(leaf sizes, held-out rows, cuts): sums of leaf values over these trees, grown level by level from nodes at ``depth``.

    ``data`` has bins, y (around the overall mean) and held; ``draws`` is (trees, rows that are not held out); ``leaves`` ascend.
    """
    cells, width = np.ascontiguousarray(data["bins"]).ravel(), data["bins"].shape[1]
    limits = [np.inf if c is None else c for c in shape.cuts]
    trees, at = np.nonzero(draws)
    w, rows = draws[trees, at].astype(float), np.flatnonzero(~data["held"])[at]
    packed, wy = w + PACK, w * data["y"][rows]
    room = len(roots) + sum(2 * (len(rows) // leaf + 1) for leaf in leaves)
    splits, below, value = np.full((len(leaves), room), -1), np.zeros((len(leaves), room), np.int64), np.zeros(room)
    size, mass = _apart(np.bincount(trees, packed, len(roots)))
    made, level = len(roots), depth
    value[:made] = np.bincount(trees, wy, made) / np.maximum(mass, 1)
    fronts = [_front(0, lambda node: roots[node], np.full((len(leaves), made), level < max(limits)), trees, size, leaves, rows * width, packed, wy)]
    while fronts:
        front = _Front(*[np.concatenate(part, axis=-1) if len(part) > 1 else part[0] for part in zip(*fronts)])
        fronts = []
        if not len(front.ids):
            break
        chosen = _chosen(cells, front, node_features(front.nodes, shape.features, shape.tried), leaves)
        splits[:, front.ids] = chosen
        level += 1
        for k in range(len(leaves)):  # leaf sizes that split a node alike share what is below
            new = (chosen[k] >= 0) & (chosen[:k] != chosen[k]).all(axis=0)
            n = np.count_nonzero(new)
            if not n:
                continue
            off, packed, wy, split, own, nodes = front.off, front.packed, front.wy, chosen[k][new], (chosen == chosen[k])[:, new], front.nodes[new]
            if n < len(new):
                rows = np.flatnonzero(np.repeat(new, front.count))
                off, packed, wy = off.take(rows), packed.take(rows), wy.take(rows)
            owner = np.repeat(np.arange(0, 2 * n, 2), front.count[new])
            owner += _right(cells, off, np.repeat(split, front.count[new]))
            size, mass = _apart(np.bincount(owner, packed, 2 * n))
            value[made : made + 2 * n] = np.bincount(owner, wy, 2 * n) / mass
            for j in range(k, len(leaves)):
                below[j, front.ids[new][own[j]]] = made + 2 * np.flatnonzero(own[j])
            deeper = np.repeat(own & (level < max(limits)), 2, axis=1)
            fronts.append(_front(made, lambda node: children(nodes[node >> 1], node & 1), deeper, owner, size, leaves, off, packed, wy))
            made += 2 * n
    return _routed(cells, np.flatnonzero(data["held"]) * width, len(roots), splits, below, value, limits, depth)


def _routed(cells: np.ndarray, offs: np.ndarray, trees: int, splits: np.ndarray, below: np.ndarray, value: np.ndarray, limits: list, level: int) -> np.ndarray:
    """Sums of the values held-out rows end with; a row goes down once for all leaf sizes until their trees part."""
    n = len(offs)
    sums = np.zeros((len(splits), n, len(limits)))

    def down(own: slice, rows: list) -> list:
        """Adds the values that are final at this level; the rows that go on."""
        here, place, off = rows
        split = splits[own.start].take(here)
        on, end = np.flatnonzero(split >= 0), np.flatnonzero(split < 0)
        ended = np.bincount(place.take(end), value.take(here.take(end)), n)
        cut = np.bincount(place, value.take(here), n) if level in limits else ended
        for c, limit in enumerate(limits):
            if limit >= level:  # the value is final where the node ends here, by itself or by the limit
                sums[own, :, c] += ended if limit > level else cut
        here, place, off, split = here.take(on), place.take(on), off.take(on), split.take(on)
        return [below[own.start].take(here) + _right(cells, off, split), place, off]

    together = [np.repeat(np.arange(trees), n), np.tile(np.arange(n), trees), np.tile(offs, trees)]
    alone = [[part[:0] for part in together] for _ in splits]
    while any(len(rows[0]) for rows in (together, *alone)):
        same = (splits[1:].take(together[0], axis=1) == splits[0].take(together[0])).all(axis=0)
        if not same.all():
            alone = [[np.concatenate([part, more[~same]]) for part, more in zip(rows, together)] for rows in alone]
            together = [part[same] for part in together]
        together = down(slice(0, len(splits)), together)
        alone = [down(slice(k, k + 1), rows) for k, rows in enumerate(alone)]
        level += 1
    return sums


# ---- rows -------------------------------------------------------------------------------

def bin_edges(df: DataFrame, x: str, features: int) -> list[np.ndarray]:
    """Quantiles of every feature over all rows; no target and no fold plays a part. At most BINS - 1 a feature."""
    marks = [i / BINS for i in range(1, BINS)]
    cells = df.select(F.posexplode(x).alias("c", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = cells.groupBy("c").agg(F.percentile_approx("v", marks, 10_000).alias("q"))
    edges = [np.zeros(0)] * features
    for row in found.collect():
        edges[row["c"]] = np.unique(row["q"])
    return edges


def binned(df: DataFrame, x: str, edges: list[np.ndarray], names: list[str]) -> DataFrame:
    """Columns ``names`` and ``__bins``: a byte a feature, MISSING where it is NULL."""
    features = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("__x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, features)
            out = np.empty(values.shape, np.uint8)
            for c in range(features):
                out[:, c] = np.where(np.isnan(values[:, c]), MISSING, np.searchsorted(edges[c], values[:, c], "left"))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array([r.tobytes() for r in out], pa.binary())], [*names, "__bins"])

    schema = T.StructType([df.schema[n] for n in names] + [T.StructField("__bins", T.BinaryType())])
    return df.select(*names, F.col(x).alias("__x")).mapInArrow(run, schema)


def _partition(batches: Iterator[pa.RecordBatch], features: int) -> dict | None:
    """All rows of a partition (bounded by the partition's size)."""
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return None
    inner = table.column("__inner").to_pylist()
    return {
        "id": table.column("__id").to_numpy(), "turn": table.column("__turn").to_numpy().view(U64), "y": table.column("__y").to_numpy(),
        "outer": table.column("__outer").to_numpy(), "inner": np.array([[i or 0 for i in r] for r in inner]),
        "bins": np.frombuffer(b"".join(table.column("__bins").to_pylist()), np.uint8).reshape(-1, features)}


def _roles(data: dict, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(training, held out) of one forest; other rows play no part."""
    outside, fold = data["outer"] == forest.outer, data["inner"][:, forest.outer]
    if not forest.left_out:
        return ~outside, outside
    return ~outside & (fold != forest.left_out), ~outside & (fold == forest.left_out)


def _filled(bins: np.ndarray, fill: dict) -> np.ndarray:
    out = bins
    for column, value in fill.items():
        if (bins[:, column] == MISSING).any():
            out = out.copy() if out is bins else out
            out[bins[:, column] == MISSING, column] = value
    return out


def _reached(top: dict, root: int, bins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Last node of the known top of a tree, its depth, and the (values, rows) met at every depth on the way."""
    node, depth, met = np.full(n, root, U64), np.zeros(n, int), []
    moving = np.arange(n)
    while len(moving):
        value, stays = np.full(n, np.nan), np.ones(len(moving), bool)
        for name in np.unique(node[moving]).tolist():
            if name not in top:
                continue
            feature, last, mean = top[name]
            here = node[moving] == name
            value[moving[here]] = mean
            if feature >= 0:
                side = bins[moving[here], feature] > last
                node[moving[here]] = children(np.full(here.sum(), name, U64), side)
                depth[moving[here]] += 1
                stays[here] = False
        met.append(value)
        moving = moving[~stays]
    return node, depth, met


# ---- levels that need all tasks ------------------------------------------------------------

def grow_tops(rows: DataFrame, forests: list[Forest], shape: Shape, node_rows: int, n: int, add_up) -> dict:
    """(forest, tree) -> {node: (feature or -1, last bin on the left, mean)} of all nodes above ``node_rows`` rows."""
    tops: dict = {(f.number, t): {} for f in forests for t in range(f.trees)} if n > node_rows else {}
    frontier = {key: [] for key in tops}
    for f in forests if tops else []:
        for t, root in enumerate(tree_roots(f, np.arange(f.trees)).tolist()):
            frontier[f.number, t] = [root]
    context = rows.sparkSession.sparkContext
    while any(frontier.values()):
        shared = context.broadcast((tops, {k: v for k, v in frontier.items() if v}))

        def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, (known, wanted) = _partition(batches, shape.features), shared.value
            for f in forests if data else []:
                train, _ = _roles(data, f)
                bins = _filled(data["bins"][train], shape.fills.get((f.outer, f.left_out), {}))
                y, turns = data["y"][train], data["turn"][train]
                for t in range(f.trees):
                    names = np.array(sorted(wanted.get((f.number, t), [])), U64)
                    if not len(names) or not len(y):
                        continue
                    root = tree_roots(f, np.array([t]))
                    w = bag(turns, root)[0]
                    node, _, _ = _reached(known[f.number, t], int(root[0]), bins, len(y))
                    at = np.minimum(np.searchsorted(names, node), len(names) - 1)
                    own = (w > 0) & (names[at] == node)
                    tried = node_features(names, shape.features, shape.tried)
                    hist = histograms(at[own], bins[np.flatnonzero(own)[:, None], tried[at[own]]], w[own].astype(float), y[own], len(names))
                    parts = hist.transpose(1, 0, 2, 3).reshape(len(names), -1)
                    part = TaskContext.get().partitionId()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.number] * len(names), pa.int32()), pa.array([t] * len(names), pa.int32()), pa.array(names.view(np.int64)),
                         pa.array([part] * len(names), pa.int32()), pa.array(parts.tolist(), pa.list_(pa.float64()))],
                        ["forest", "tree", "node", "part", "values"])

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaf_of = {f.number: f.leaf for f in forests}
            for batch in batches:
                out = []
                for forest, tree, node, values in zip(*(batch.column(c).to_pylist() for c in ("forest", "tree", "node", "values"))):
                    hist = np.array(values).reshape(3, 1, shape.tried, BINS)
                    slot, last, splits = best_splits(hist, leaf_of[forest])
                    total, left = hist[:, 0, 0].sum(axis=1), hist[0, 0, slot[0], : last[0] + 1].sum()
                    feature = node_features(np.array([node], np.int64).view(U64), shape.features, shape.tried)[0, slot[0]] if splits[0] else -1
                    out.append((forest, tree, node, int(feature), int(last[0]), float(total[2] / max(total[1], 1)), int(left), int(total[0] - left)))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                columns = list(zip(*out)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["forest", "tree", "node", "feature", "last", "mean", "l", "r"])

        partial = rows.mapInArrow(level, "forest int, tree int, node long, part int, values array<double>")
        chosen = add_up(partial, ["forest", "tree", "node"]).mapInArrow(split, "forest int, tree int, node long, feature int, last int, mean double, l long, r long")
        frontier = {key: [] for key in tops}
        for r in chosen.collect():
            name = int(np.int64(r["node"]).view(U64))
            tops[r["forest"], r["tree"]][name] = (r["feature"], r["last"], r["mean"])
            if r["feature"] >= 0:
                below = children(np.full(2, name, U64), np.arange(2)).tolist()
                frontier[r["forest"], r["tree"]] += [c for c, size in zip(below, (r["l"], r["r"])) if size > node_rows]
    return tops


# ---- tables that one task holds ----------------------------------------------------------------

PACKED = {"id": np.int64, "turn": U64, "y": np.float64, "outer": np.int32, "inner": np.int32, "bins": np.uint8}


def _shared_out(rows: DataFrame, forests: list[Forest], shape: Shape, names: list[str]) -> DataFrame:
    """(forest, id, sums): every task gets the whole table, packed, and an even run of all trees in order."""
    alike: dict[tuple, list[Forest]] = {}
    for f in sorted(forests, key=lambda f: f.leaf):
        alike.setdefault((f.outer, f.left_out, f.trees, f.seed), []).append(f)
    together = list(alike.values())  # forests that differ in their leaf size only
    trees = [(g, t) for g, some in enumerate(together) for t in range(some[0].trees)]
    tasks = min(len(trees), SHARES * rows.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _partition(batches, shape.features)
        for low in range(0, len(data["id"]) if data else 0, CHUNK_ROWS):
            parts = [np.ascontiguousarray(data[name][low : low + CHUNK_ROWS], kind).tobytes() for name, kind in PACKED.items()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in parts], list(PACKED))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {name: [] for name in PACKED}
        for batch in batches:
            task = batch.column("task")[0].as_py()
            for name, kind in PACKED.items():
                parts[name] += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(name)]
        if not parts["id"]:
            return
        data = {name: np.concatenate(part) for name, part in parts.items()}
        data |= {"inner": data["inner"].reshape(len(data["id"]), -1), "bins": data["bins"].reshape(-1, shape.features)}
        order = np.lexsort((data["id"], data["turn"]))  # sums in one order, however rows arrive
        data = {name: part[order] for name, part in data.items()}
        own: dict[int, list[int]] = {}
        for g, t in trees[len(trees) * task // tasks : len(trees) * (task + 1) // tasks]:
            own.setdefault(g, []).append(t)
        for g, numbers in own.items():
            f = together[g][0]
            train, held = _roles(data, f)
            part = np.flatnonzero(train | held)
            if not held.any():
                continue
            mine = {"bins": _filled(data["bins"][part], shape.fills.get((f.outer, f.left_out), {})), "y": data["y"][part], "held": held[part]}
            sums, step = 0.0, max(1, SAMPLES // len(part))
            for low in range(0, len(numbers), step):
                roots = tree_roots(f, np.array(numbers[low : low + step]))
                sums = sums + grow(mine, [f.leaf for f in together[g]], shape, roots, bag(data["turn"][train], roots), 0)
            for f, found in zip(together[g], sums):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.number] * len(found), pa.int32()), pa.array(data["id"][held]), *[pa.array(found[:, c].copy()) for c in range(len(names))]],
                    ["forest", "id", *names])

    packed = rows.select("__id", "__turn", "__y", "__outer", "__inner", "__bins").mapInArrow(pack, ", ".join(f"{name} binary" for name in PACKED))
    every = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    return every.mapInArrow(grown, "forest int, id long, " + ", ".join(f"{p} double" for p in names))


# ---- nodes that one task grows ---------------------------------------------------------------

def held_out_means(rows: DataFrame, forests: list[Forest], shape: Shape, add_up, node_rows: int | None = None) -> DataFrame:
    """(forest, id, p0, p1, ...): forest means of every row held out of a forest, one column a cut.

    ``rows`` is stored and has __id, __turn, __y (around the overall mean), __outer (position), __inner and __bins.
    """
    n = rows.count()
    node_rows = node_rows or max(NODE_ROWS, NODE_BYTES // (shape.features + ROW_BYTES))
    names = [f"p{c}" for c in range(len(shape.cuts))]
    out = _shared_out(rows, forests, shape, names) if n <= node_rows else _dealt(rows, forests, shape, names, grow_tops(rows, forests, shape, node_rows, n, add_up))
    count = F.create_map(*[F.lit(v) for f in forests for v in (f.number, float(f.trees))])
    return out.groupBy("forest", "id").agg(*[F.sum(p).alias(p) for p in names]).select("forest", "id", *[(F.col(p) / F.element_at(count, F.col("forest"))).alias(p) for p in names])


def _dealt(rows: DataFrame, forests: list[Forest], shape: Shape, names: list[str], tops: dict) -> DataFrame:
    """(forest, id, sums) of a table beyond one task: every tree's rows are dealt by the node of its known top they reach."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)
    limits = [np.inf if c is None else c for c in shape.cuts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, known = _partition(batches, shape.features), shared.value
        for f in forests if data else []:
            train, held = _roles(data, f)
            part = np.flatnonzero(train | held)
            if not len(part):
                continue
            bins = _filled(data["bins"][part], shape.fills.get((f.outer, f.left_out), {}))
            packed = [r.tobytes() for r in bins]
            roots = tree_roots(f, np.arange(f.trees))
            for first in range(f.trees):
                top = known[f.number, first]
                node, depth, met = _reached(top, int(roots[first]), bins, len(part))
                ended = np.isin(node, np.array([k for k, v in top.items() if v[0] < 0], U64))
                keep = np.flatnonzero(held[part] | ((bag(data["turn"][part], roots[first : first + 1])[0] > 0) & ~ended))
                early = np.full((len(part), len(limits)), np.nan)
                for c, limit in enumerate(limits):
                    for d, value in enumerate(met):
                        due = (depth > d) & (limit == d) | ended & (depth == d) & (limit >= d)
                        early[due, c] = value[due]
                lists = pa.array(early[keep].tolist(), pa.list_(pa.float64()))
                for low in range(0, len(keep), 10_000):
                    some = keep[low : low + 10_000]
                    rows_ = part[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.number] * len(some), pa.int32()), pa.array([first] * len(some), pa.int32()), pa.array(node[some].view(np.int64)),
                         pa.array(depth[some], pa.int32()), pa.array(data["id"][rows_]), pa.array(data["turn"][rows_].view(np.int64)),
                         pa.array(data["y"][rows_]), pa.array(held[rows_]), pa.array([packed[i] for i in some], pa.binary()), lists.slice(low, len(some))],
                        ["forest", "first", "node", "depth", "id", "turn", "y", "held", "bins", "early"])

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        f, first, node, depth = forests[key[0].as_py()], key[1].as_py(), key[2].as_py(), key[3].as_py()
        order = np.lexsort((table.column("id").to_numpy(), table.column("turn").to_numpy()))  # sums in one order, however rows arrive
        table = table.take(pa.array(order))
        held = table.column("held").to_numpy()
        data = {"bins": np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, shape.features), "y": table.column("y").to_numpy(), "held": held}
        turns = table.column("turn").to_numpy().view(U64)
        root = np.array([node], np.int64).view(U64)
        draws = bag(turns[~held], tree_roots(f, np.array([first])))
        sums = grow(data, [f.leaf], shape, root, draws, depth)[0] if held.any() else np.zeros((0, len(limits)))
        early = np.array([e if e is not None else [np.nan] * len(limits) for e, h in zip(table.column("early").to_pylist(), held) if h]).reshape(-1, len(limits))
        sums = np.where(np.isnan(early), sums, early)
        return pa.table({"forest": pa.array([f.number] * len(sums), pa.int32()), "id": table.column("id").filter(pa.array(held)),
                         **{name: pa.array(sums[:, c]) for c, name in enumerate(names)}})

    own = ["__id", "__turn", "__y", "__outer", "__inner", "__bins"]
    dealt = rows.select(*own).mapInArrow(deal, "forest int, first int, node long, depth int, id long, turn long, y double, held boolean, bins binary, early array<double>")
    return dealt.groupBy("forest", "first", "node", "depth").applyInArrow(grown, "forest int, id long, " + ", ".join(f"{p} double" for p in names))
