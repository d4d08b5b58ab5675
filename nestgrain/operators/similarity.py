"""Vector similarity search, optimal one-to-one assignment and omission inference."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import largest_group, materialise, small
from .contracts import GateError
from .ordered import running_sum, top_within

TILE = 8192
PROBE_TILES, DATA_TILES = 2, 4  # tiles of probes and of data that meet in one task: larger ones are copied less often
FIRST_COLUMNS, COLUMNS, ROWS = 256, 4096, 512  # scores worked out at once
MAX_PIVOTS = 1024
SCORE_DIGITS = 10


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def top_k_similar(
    left: DataFrame, right: DataFrame, id_col: str, vector: str, k: int, block: list[str] | None = None,
    exclude_same: bool = False, tile: int = TILE, pivots: int | None = None,
) -> DataFrame:
    """The k right vectors with the largest dot product for each left vector (exact; ties to the lower id).

    With ``block`` only vectors of the same block are compared. Otherwise the right
    side is split into cells around pivot vectors (about one per four tiles of data,
    at most ``MAX_PIVOTS``). A left vector
    first searches its nearest pivot's cell; then only cells whose best conceivable
    score (pivot score plus cell radius) still reaches its k-th score are searched.
    Cells of any size are cut into tiles, so no task holds more than about six
    tiles, and each pair of cuts yields only its top k, never its score matrix.
    """
    keys = block or []
    spark = left.sparkSession
    a = left.select(*keys, F.col(id_col).alias("qid"), F.col(vector).alias("qv"))
    b = right.select(*keys, F.col(id_col).alias("sid"), F.col(vector).alias("sv"))
    if keys:
        return _search(a, b.withColumn("__cell", F.lit(0)), a.withColumn("__cell", F.lit(0)), keys, k, exclude_same, tile)

    if pivots is None:
        pivots = min(MAX_PIVOTS, b.count() // (4 * tile))
    centres = [row[0] for row in b.orderBy(F.xxhash64("sid"), "sid").limit(pivots).select("sv").collect()] if pivots > 1 else []
    if len(centres) < 2:
        return _search(a.withColumn("__cell", F.lit(0)), b.withColumn("__cell", F.lit(0)), a.withColumn("__cell", F.lit(0)), [], k, exclude_same, tile)
    shared = spark.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def nearest_cell(column: str):
        def run(batches):
            points = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v = _matrix(pdf[column])
                gap = (v * v).sum(1)[:, None] - 2 * v @ points.T + (points * points).sum(1)[None, :]
                cell = gap.argmin(1)
                exact = np.sqrt(((v - points[cell]) ** 2).sum(1))
                yield pdf.assign(__cell=cell.astype("int32"), __gap=exact)
        return run

    def with_cell(df: DataFrame, column: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__gap", T.DoubleType())])
        return df.mapInPandas(nearest_cell(column), schema)

    b_cells = materialise(with_cell(b, "sv"))
    radii = {row["__cell"]: row["r"] for row in b_cells.groupBy("__cell").agg(F.max("__gap").alias("r")).collect()}
    b_cells = b_cells.drop("__gap")
    own = materialise(with_cell(a, "qv").drop("__gap"))
    first = materialise(_search(a, b_cells, own, [], k, exclude_same, tile))
    reach = first.groupBy("qid").agg(F.min("score").alias("__kth"), F.count(F.lit(1)).alias("__found"))
    pending = own.join(reach, "qid", "left")
    out_schema = T.StructType([f for f in own.schema.fields if f.name != "__cell"] + [T.StructField("__cell", T.IntegerType())])

    def other_cells(batches):
        points = shared.value
        order = np.array(sorted(radii), dtype=int)
        radius = np.array([radii[c] for c in order])
        for pdf in batches:
            if not len(pdf):
                continue
            v = _matrix(pdf["qv"])
            best = v @ points[order].T + np.linalg.norm(v, axis=1)[:, None] * radius[None, :]
            kth = np.where(pdf["__found"].fillna(0).to_numpy() >= k, pdf["__kth"].astype(float).fillna(-np.inf), -np.inf)
            open_ = (best >= kth[:, None] - 1e-8) & (order[None, :] != pdf["__cell"].to_numpy()[:, None])
            row, col = np.nonzero(open_)
            yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[row], "qv": pdf["qv"].to_numpy()[row], "__cell": order[col].astype("int32")})

    probes = pending.mapInPandas(other_cells, out_schema)
    second = _search(a, b_cells, probes, [], k, exclude_same, tile)
    both = first.drop("rank").unionByName(second.drop("rank"))
    return _rank(both, [], k)


def _rank(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    ranked = top_within(hits, [*keys, "qid"], [F.col("score").desc(), "sid"], k)
    return ranked.select(*keys, "qid", "sid", "score", F.col("rank").cast("bigint").alias("rank"))


def _array(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _top_scores(
    q: np.ndarray, s: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k largest rounded products, ties to the lower column; columns own[0] to own[1] of a row do not count.

    Scores are worked out a block at a time, and only those above a row's k-th so far are looked at
    again: columns come in order, so a later one that ties does not count.
    """
    out = []
    for low in range(0, len(q), ROWS):
        some = q[low : low + ROWS]
        n = len(some)
        value, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        first = 0
        while first < len(s):
            last = min(len(s), first + (COLUMNS if first else FIRST_COLUMNS))
            score = some @ s[first:last].T
            if own is not None:
                start, stop = (np.clip(o[low : low + ROWS], first, last) - first for o in own)
                times = stop - start
                score[np.repeat(np.arange(n), times), np.repeat(start + times - np.cumsum(times), times) + np.arange(times.sum())] = -np.inf
            kth = value[:, -1]
            # a little low, as rounding may lift a score over the k-th one
            row, col = np.nonzero(score >= (kth + 0.4 * 10.0 ** -SCORE_DIGITS - 4e-13 * np.abs(kth))[:, None])
            new = np.round(score[row, col], SCORE_DIGITS) + 0.0
            better = (new > kth[row]) & np.isfinite(new)
            if better.any():
                rows = np.concatenate([np.repeat(np.arange(n), k), row[better]])
                values = np.concatenate([value.ravel(), new[better]])
                places = np.concatenate([place.ravel(), col[better] + first])
                order = np.lexsort((places, -values, rows))
                rows = rows[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                kept = rank < k
                value[rows[kept], rank[kept]], place[rows[kept], rank[kept]] = values[order][kept], places[order][kept]
            first = last
        row, rank = np.nonzero(place >= 0)
        out.append((row + low, place[row, rank], value[row, rank]))
    return tuple(np.concatenate(part) for part in zip(*out))


def _search(a: DataFrame, data: DataFrame, probes: DataFrame, keys: list[str], k: int, exclude_same: bool, tile: int) -> DataFrame:
    """Top k per probe over its cell: replicate probes over data tiles and data over probe tiles."""
    cell = [*keys, "__cell"]
    sizes = data.groupBy(*cell).agg(F.count(F.lit(1)).alias("__nd")).join(
        probes.groupBy(*cell).agg(F.count(F.lit(1)).alias("__nq")), cell)
    sizes = sizes.select(
        *cell, F.ceil(F.col("__nd") / (DATA_TILES * tile)).cast("int").alias("__td"), F.ceil(F.col("__nq") / (PROBE_TILES * tile)).cast("int").alias("__tq"))
    sizes = small(materialise(sizes))
    mine, every = F.pmod(F.xxhash64("qid"), F.col("__tq")), F.sequence(F.lit(0), F.col("__td") - 1)
    q = probes.join(sizes, cell).withColumn("__a", mine.cast("int")).withColumn("__b", F.explode(every)).drop("__td", "__tq")
    mine, every = F.pmod(F.xxhash64("sid"), F.col("__td")), F.sequence(F.lit(0), F.col("__tq") - 1)
    s = data.join(sizes, cell).withColumn("__b", mine.cast("int")).withColumn("__a", F.explode(every)).drop("__td", "__tq")
    fields = [probes.schema[name] for name in keys] + [
        T.StructField("qid", probes.schema["qid"].dataType), T.StructField("sid", data.schema["sid"].dataType),
        T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)

    def best(qs: pa.Table, ss: pa.Table) -> pa.Table:
        if not qs.num_rows or not ss.num_rows:
            return pa.table({name: pa.array([], (qs if name in keys or name == "qid" else ss).schema.field(name).type)
                             if name != "score" else pa.array([], pa.float64()) for name in schema.names})
        ss = ss.sort_by("sid")
        own = None
        if exclude_same:
            ids, mine = (t.to_numpy() for t in (ss.column("sid"), qs.column("qid")))
            own = np.searchsorted(ids, mine), np.searchsorted(ids, mine, side="right")
        row, col, value = _top_scores(_array(qs.column("qv")), _array(ss.column("sv")), k, own)
        taken, found = qs.select([*keys, "qid"]).take(pa.array(row)), ss.column("sid").take(pa.array(col))
        return taken.append_column("sid", found).append_column("score", pa.array(value))

    tiles = [*cell, "__a", "__b"]
    # fresh column ids: both sides may stem from one table, which cogroup cannot tell apart
    s = s.select(*[F.col(name).alias(name) for name in s.columns])
    hits = q.groupBy(*tiles).cogroup(s.groupBy(*tiles)).applyInArrow(best, schema)
    return _rank(hits, keys, k)


# ---- assignment --------------------------------------------------------------------

def optimal_assignment(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a cost matrix with rows <= columns, minimising the total.

    Shortest augmenting paths with dual potentials, the inner scan vectorised.
    """
    rows, columns = cost.shape
    owner = np.full(columns, -1)
    price_row, price_col = np.zeros(rows), np.zeros(columns)
    for start in range(rows):
        distance = np.full(columns, np.inf)
        parent = np.full(columns, -1)
        done = np.zeros(columns, dtype=bool)
        row, base, last = start, 0.0, -1
        visited = [start]
        while True:
            reduced = base + cost[row] - price_row[row] - price_col
            better = ~done & (reduced < distance)
            distance[better] = reduced[better]
            parent[better] = last
            last = int(np.where(done, np.inf, distance).argmin())
            base = distance[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
            visited.append(row)
        settled = np.flatnonzero(done)
        for column in settled:
            if owner[column] >= 0:
                price_row[owner[column]] += base - distance[column]
        price_row[start] += base
        price_col[settled] -= base - distance[settled]
        while last >= 0:
            before = parent[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.empty(rows, dtype=int)
    taken = np.flatnonzero(owner >= 0)
    out[owner[taken]] = taken
    return out


def _solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if cost.shape[0] <= cost.shape[1]:
        return np.arange(cost.shape[0]), optimal_assignment(cost)
    columns = np.arange(cost.shape[1])
    rows = optimal_assignment(cost.T)
    order = np.argsort(rows)
    return rows[order], columns[order]


def require_bounded_blocks(df: DataFrame, block: list[str], limit: int) -> None:
    """The optimum needs a whole block in one task, so its size is part of the contract."""
    found = largest_group(df, block)
    if found > limit:
        raise GateError(f"assignment block of {found} rows exceeds the limit of {limit}; use narrower blocks")


def assign_vectors(left: DataFrame, right: DataFrame, block: list[str], id_col: str, vector: str, limit: int = 2000) -> DataFrame:
    """Per block, the one-to-one pairing of left and right vectors with the largest mean correlation.

    Vectors are fingerprints (z-scores), so dot product over length is correlation.
    Blocks present on one side only have no pairing.
    """
    require_bounded_blocks(left, block, limit)
    require_bounded_blocks(right, block, limit)
    a = left.select(*block, F.col(id_col).alias("left_id"), F.col(vector).alias("v"))
    b = right.select(*block, F.col(id_col).alias("right_id"), F.col(vector).alias("v"))
    fields = [a.schema[name] for name in block] + [
        T.StructField("left_id", a.schema["left_id"].dataType), T.StructField("right_id", b.schema["right_id"].dataType),
        T.StructField("correlation", T.DoubleType())]

    def pair(ls: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(ls) or not len(rs):
            return pd.DataFrame({f.name: [] for f in fields})
        ls, rs = ls.sort_values("left_id"), rs.sort_values("right_id")
        u, v = _matrix(ls["v"]), _matrix(rs["v"])
        similarity = u @ v.T / u.shape[1]
        i, j = _solve(-similarity)
        out = {name: [ls[name].iloc[0]] * len(i) for name in block}
        out |= {"left_id": ls["left_id"].to_numpy()[i], "right_id": rs["right_id"].to_numpy()[j], "correlation": similarity[i, j]}
        return pd.DataFrame(out)

    b = b.select(*[F.col(name).alias(name) for name in b.columns])
    return a.groupBy(*block).cogroup(b.groupBy(*block)).applyInPandas(pair, T.StructType(fields))


def assign_scores(scores: DataFrame, block: list[str], row: str, column: str, cost: str, missing: float, limit: int = 4_000_000) -> DataFrame:
    """Per block, the minimum-cost one-to-one pairing from a long (row, column, cost) table.

    Absent pairs cost ``missing`` and are dropped from the answer if chosen.
    """
    require_bounded_blocks(scores, block, limit)
    fields = [scores.schema[name] for name in block] + [scores.schema[row], scores.schema[column], T.StructField(cost, T.DoubleType())]

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.sort(pdf[row].unique()), np.sort(pdf[column].unique())
        table = np.full((len(rows), len(columns)), float(missing))
        i, j = np.searchsorted(rows, pdf[row]), np.searchsorted(columns, pdf[column])
        table[i, j] = pdf[cost].to_numpy(float)
        known = np.zeros_like(table, dtype=bool)
        known[i, j] = True
        r, c = _solve(table)
        keep = known[r, c]
        out = {name: [pdf[name].iloc[0]] * int(keep.sum()) for name in block}
        out |= {row: rows[r[keep]], column: columns[c[keep]], cost: table[r, c][keep]}
        return pd.DataFrame(out)

    return scores.groupBy(*block).applyInPandas(pair, T.StructType(fields))


def value_mismatches(extracted: DataFrame, labels: DataFrame, block: list[str], case: str, location: str, point: str, value: str) -> DataFrame:
    """(block, location, point, mismatches) over a block's cases, counted from the matches only.

    Joining on equal values produces just the agreeing entries; everything else is
    the block's case count minus those. Pairs that never agree are absent.
    """
    cases = extracted.select(*block, case).distinct().groupBy(*block).agg(F.count(F.lit(1)).alias("__cases"))
    left = extracted.select(*block, case, location, value)
    right = labels.select(*block, case, point, value)
    matches = left.join(right, [*block, case, value]).groupBy(*block, location, point).agg(F.count(F.lit(1)).alias("__m"))
    return matches.join(small(cases), block).select(
        *block, location, point, (F.col("__cases") - F.col("__m")).cast("double").alias("mismatches"))


def omission_scores(evidence: DataFrame, names: DataFrame, group: str, index: str) -> DataFrame:
    """For each possible omitted name index, how much evidence fits, from two running counts.

    A pair supports omission o when index = group for groups below o, or group + 1
    from o on. So matches(o) counts index = group with group < o, plus index = group + 1
    with group >= o.
    """
    same = F.col(index) == F.col(group)
    shifted = F.col(index) == F.col(group) + 1
    hits = evidence.groupBy(F.col(group).alias("__o")).agg(
        F.count_if(same).alias("__same"), F.count_if(shifted).alias("__shift"))
    candidates = names.select(F.col(index).alias("__o")).distinct()
    grid = candidates.withColumn("__is", F.lit(True)).join(hits, "__o", "full_outer").fillna(0, ["__same", "__shift"])
    # both totals change only where evidence sits, so one pass of each is enough
    below = running_sum(grid, [], ["__o"], "__same", "__cum_same")
    both = running_sum(below, [], ["__o"], "__shift", "__cum_shift")
    every = evidence.agg(F.count_if(shifted)).first()[0]
    score = (F.col("__cum_same") - F.col("__same")) + (F.lit(every) - (F.col("__cum_shift") - F.col("__shift")))
    return both.where(F.col("__is")).select(F.col("__o").alias("omitted_index"), score.cast("bigint").alias("matches"))


def infer_omission(evidence: DataFrame, names: DataFrame, group: str, index: str) -> DataFrame:
    """One row: evidence count, best omission, and whether it is unique and explains everything."""
    scores = materialise(omission_scores(evidence, names, group, index))
    total = evidence.count()
    best = scores.agg(F.max("matches")).first()[0]
    tied = scores.where(F.col("matches") == best)
    return tied.agg(
        F.lit(total).cast("bigint").alias("evidence"), F.lit(best).cast("bigint").alias("best_matches"),
        ((F.count(F.lit(1)) == 1) & (F.lit(best) == F.lit(total))).alias("unique_complete"),
        F.when((F.count(F.lit(1)) == 1) & (F.lit(best) == F.lit(total)), F.min("omitted_index")).alias("omitted_index"),
    )


def correlation_gate(pairs: DataFrame, correlation: str, least: float = 0.99999) -> DataFrame:
    """One row: matched pairs, the weakest correlation, pairs below ``least`` (or undefined), and whether all pass.

    No pairs at all do not pass.
    """
    failing = ~F.coalesce(F.col(correlation) >= least, F.lit(False)) | F.isnan(correlation)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.min(correlation).alias("weakest"), F.count_if(failing).alias("n_below"),
    ).withColumn("passed", (F.col("pairs") > 0) & (F.col("n_below") == 0))
