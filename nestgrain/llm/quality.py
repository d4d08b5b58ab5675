"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes slide over the whole text in steps of two, and the
responses are max-pooled over chunks of 1,024 bytes that overlap by half. The mean, minimum
and maximum over the chunks of each pooled response, and how far the text falls short of one
chunk (alone and times the mean, as a short text cannot fill its pools), go through one
logistic unit. For scoring, embedding and filters fold into one table per byte pair and filter quarter, so a
response is four table rows added up.

The network is fitted on the driver from a bounded sample of labelled rows: whole texts, smallest
id hashes first, until ``MAX_TRAIN_ROWS`` rows or ``MAX_TRAIN_BYTES`` bytes in all are reached.
No text is passed over for its own length, so long ones are in the sample as often as they are
in the table. Fitting and scoring run over every byte, in segments of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import text_chunks

WIDTH, DIM, FILTERS = 8, 6, 24
POOL = 256  # positions (two bytes each) in half a chunk
SEGMENT = 1 << 15  # positions convolved at once
CHUNK = 1 << 16  # text bytes of whole short texts scored together
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 3000, 16 << 20
FEATURES = 4 * FILTERS + 2
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 11
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # FEATURES
    constant: float

    def tables(self) -> list[np.ndarray]:
        """Response of each byte pair in each quarter of the filters."""
        per_byte = [self.embed @ self.filters[j * DIM : (j + 1) * DIM] for j in range(WIDTH)]
        return [np.ascontiguousarray((per_byte[j + 1][:, None, :] + per_byte[j][None, :, :]).reshape(65536, FILTERS), np.float32)
                for j in range(0, WIDTH, 2)]


def positions(length: int) -> int:
    return 1 if length <= WIDTH else -(-(length - WIDTH) // 2) + 1


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out one after another in whole byte pairs, each closed by zeros; (pairs, first pair, positions)."""
    counts = np.array([positions(n) for n in np.diff(offsets).tolist()], np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts + WIDTH // 2 - 1)])
    room = np.zeros(2 * firsts[-1], np.uint8)
    for first, a, b in zip(firsts[:-1].tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        room[2 * first : 2 * first + b - a] = data[a:b]
    return room.view("<u2"), firsts, counts


def combined(halves: np.ndarray, count: int) -> np.ndarray:
    """Features of one text from the rectified maxima of its half chunks and its number of positions."""
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    short = max(0.0, 1 - count / (2 * POOL))
    mean = chunks.mean(0)
    return np.concatenate([mean, chunks.min(0), chunks.max(0), short * mean, [short, short * short]])


def chunk_features(pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(-(-counts // POOL)).tolist()
    return np.array([combined(pooled[a:b], n) for a, b, n in zip([0, *ends[:-1]], ends, counts.tolist())])


def responses(pairs: np.ndarray, tables: list[np.ndarray], n: int) -> np.ndarray:
    index = pairs[: n + len(tables) - 1].astype(np.intp)
    total = np.take(tables[0], index[:n], axis=0, mode="clip")
    part = np.empty_like(total)
    for j in range(1, len(tables)):
        total += np.take(tables[j], index[j : n + j], axis=0, mode="clip", out=part)
    return total


def half_chunk_maxima(pairs: np.ndarray, firsts: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    parts = []
    if len(counts) == 1:  # possibly a very long text: fixed segments, aligned to the pooling blocks
        for low in range(0, int(counts[0]), SEGMENT):
            n = min(SEGMENT, int(counts[0]) - low)
            parts.append(np.maximum.reduceat(responses(pairs[low:], tables, n), np.arange(0, n, POOL), axis=0))
        return np.concatenate(parts)
    n = len(pairs) - (WIDTH // 2 - 1)
    cuts, real = [], []
    for first, count in zip(firsts[:-1].tolist(), counts.tolist()):
        inside = range(first, first + count, POOL)
        cuts += [*inside, first + count]
        real += [True] * len(inside) + [False]
    cuts, real = np.array(cuts[:-1]), np.array(real[:-1])
    return np.maximum.reduceat(responses(pairs, tables, n), cuts, axis=0)[real]


def score_texts(data: np.ndarray, offsets: np.ndarray, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    pairs, firsts, counts = padded(data, offsets)
    pooled = half_chunk_maxima(pairs, firsts, counts, tables)
    features = chunk_features(np.maximum(pooled + net.bias, 0), counts)
    return 1 / (1 + np.exp(-(features.astype(np.float64) @ net.weights + net.constant)))


def fit(texts: list[bytes], labels: np.ndarray) -> Network | None:
    """Adam on the logistic loss with both classes weighted alike up to a factor of two; None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    share = labels.mean()
    weight = np.where(labels > 0, 1.0, min(3.0, max(1.0, share / (1 - share) / 2)))
    params = {
        "embed": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)),
        "bias": np.zeros(FILTERS), "weights": rng.normal(0, 0.1, FEATURES), "constant": np.zeros(1),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            step += 1
            for name, grad in gradients(params, [texts[i] for i in rows], labels[rows], weight[rows]).items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                params[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params["embed"], params["filters"], params["bias"], params["weights"], float(params["constant"][0]))


def gradients(params: dict, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict:
    """Loss gradients of one batch; only the positions that win a pool carry any."""
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    pairs, firsts, counts = padded(np.frombuffer(b"".join(texts), np.uint8), offsets)
    bytes_ = pairs.view(np.uint8)
    table, filters = params["embed"].astype(np.float32), params["filters"].astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in params.items()}
    features, routes = [], []
    for first, count in zip(firsts[:-1].tolist(), counts.tolist()):
        halves = -(-count // POOL)
        where, best = np.empty((halves, FILTERS), np.int64), np.empty((halves, FILTERS), np.float32)
        for low in range(0, count, SEGMENT):
            n = min(SEGMENT, count - low)
            part = table[bytes_[2 * (first + low) : 2 * (first + low + n - 1) + WIDTH]].reshape(-1)
            room = np.full((-(-n // POOL) * POOL, FILTERS), -np.inf, np.float32)
            room[:n] = np.lib.stride_tricks.sliding_window_view(part, WIDTH * DIM)[:: 2 * DIM] @ filters
            room = room.reshape(-1, POOL, FILTERS)
            rows = slice(low // POOL, low // POOL + len(room))
            where[rows] = room.argmax(axis=1) + (low + np.arange(len(room)) * POOL)[:, None]
            best[rows] = room.max(axis=1)
        pooled = best + params["bias"]
        features.append(combined(np.maximum(pooled, 0), count))
        if halves > 1:
            right = pooled[1:] > pooled[:-1]
            where, pooled = np.where(right, where[1:], where[:-1]), np.where(right, pooled[1:], pooled[:-1])
        active = np.maximum(pooled, 0)
        routes.append((first, where, pooled > 0, active.argmin(0), active.argmax(0), max(0.0, 1 - count / (2 * POOL))))
    features = np.array(features)
    score = 1 / (1 + np.exp(-np.clip(features @ params["weights"] + params["constant"][0], -30, 30)))
    delta = (score - labels) * weight / len(texts)
    grads["weights"] = features.T @ delta + 1e-4 * params["weights"]
    grads["constant"][0] = delta.sum()
    mean_w, min_w, max_w, short_w = params["weights"][: 4 * FILTERS].reshape(4, FILTERS)
    column = np.arange(FILTERS)
    for d, (first, where, alive, lowest, highest, short) in zip(delta, routes):
        g = np.tile(d * (mean_w + short * short_w) / len(where), (len(where), 1))
        g[lowest, column] += d * min_w
        g[highest, column] += d * max_w
        g *= alive
        grads["bias"] += g.sum(0)
        chunk, filt = np.nonzero(g)
        values, at = g[chunk, filt], where[chunk, filt]
        index = 2 * (first + at)[:, None] + np.arange(WIDTH)
        seen = bytes_[index]
        np.add.at(grads["filters"].T, filt, values[:, None] * params["embed"][seen].reshape(len(at), -1))
        back = values[:, None, None] * params["filters"].T[filt].reshape(len(at), WIDTH, DIM)
        np.add.at(grads["embed"], seen, back)
    return grads


def training_rows(docs: DataFrame, labels: DataFrame, usable, label: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """The bounded training sample: usable labelled ids by smallest hash, with their whole texts.

    Ids that are null or have no label 0 or 1 do not count; of several labels of an id the largest
    does. Rows with a null text are no examples. Repeated documents of a sampled id are several
    examples. Only ids and sizes are looked at first; the sample ends before the row that would
    take it past ``MAX_TRAIN_BYTES``. Other columns play no part.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    known = known.where(usable(F.col("__id"))).groupBy("__id").agg(F.max("__label").alias("__label"))
    order = F.xxhash64("__id", F.lit(SEED))
    known = known.orderBy(order, "__id").limit(MAX_TRAIN_ROWS)
    own = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    rows = own.join(F.broadcast(known), F.col("__doc") == F.col("__id")).where("__text IS NOT NULL")
    sizes = rows.groupBy("__id").agg(F.sum(F.octet_length("__text")).alias("n"), F.min(order).alias("turn")).collect()
    taken, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["turn"], r["__id"])):
        total += row["n"]
        if total > MAX_TRAIN_BYTES:
            break
        taken.append((row["__id"],))
    if not taken:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame(taken, f"__taken {known.schema['__id'].dataType.simpleString()}")
    found = rows.join(F.broadcast(chosen), F.col("__id") == F.col("__taken")).select("__id", "__text", "__label").collect()
    found = sorted((r["__id"], r["__text"], r["__label"]) for r in found)
    return [t.encode() for _, t, _ in found], np.array([y for *_, y in found], float)


def quality_scores(docs: DataFrame, net: Network | None, keep: list[str], score: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and ``score`` (the column's name is free) in 0..1 for every row.

    A null text counts as empty; an empty text is scored as one window of zero bytes. Without
    a network (no labels of both kinds) every score is 0.5. Repeated rows are scored each; an
    empty table gives an empty result; kept columns may have any names but that of the score.
    """
    if score in keep:
        raise ValueError(f"column {score} is there already: name the score otherwise")
    text = next(f"__text{n}" for n in range(len(keep) + 1) if f"__text{n}" not in keep)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias(text))
    fields = T.StructType([docs.schema[k] for k in keep] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            texts = batch.column(len(keep))
            for low, high, data, offsets in text_chunks(texts, CHUNK):
                found = score_texts(data, offsets, net, tables) if net else np.full(high - low, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(i)[low:high] for i in range(len(keep))] + [pa.array(found, pa.float64())], [*keep, score])

    return rows.mapInArrow(run, fields)
