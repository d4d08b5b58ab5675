"""Language of a text by prediction by partial matching over bytes.

Per language a context tree of up to ``ORDER`` preceding symbols holds how often each symbol
followed. A symbol seen in a context costs -log2(count / (total + distinct)); otherwise the
escape probability distinct / (total + distinct) is paid and the next shorter context decides
among the symbols not seen (exclusion), down to an even spread. Statistics are frozen after
training, so the tree can be laid out as one table of exact code lengths for every context
and symbol, and a text's code length under a language is a sum of table entries.

Symbols are bytes with A-Z folded: the ``ALPHABET - 1`` most frequent bytes of the training
texts each, all others together. Which of the others it is is coded after that symbol, by a
second tree over all 256 bytes with one byte of context, so every byte counts in every language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_chunks

ORDER, ALPHABET = 3, 36
REST_ORDER, BYTES = 1, 256
FIRST_REST = ALPHABET ** (ORDER + 1)  # numbers from here on are (byte before, byte) of the other bytes
CHUNK = 1 << 19


def _folded(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table[data]


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for _, _, data, _ in text_chunks(batch.column(0), CHUNK):
            total += np.bincount(_folded(data), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def context_codes(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Context and symbol of every byte as one number; a text starts in the context of the common other symbol 0."""
    s = symbol[data].astype(np.int32)
    code = s.copy()
    for back in range(1, ORDER + 1):
        shifted = np.zeros_like(s)
        shifted[back:] = s[:-back]
        for step in range(back):  # no context from the text before
            at = offsets[:-1] + step
            at = at[at < np.minimum(offsets[1:], len(s))]
            shifted[at] = 0
        code += shifted * ALPHABET**back
    return code


def rest_codes(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes without a symbol of their own, and (byte before, byte) of each as one number; before a text comes byte 0."""
    at = np.flatnonzero(symbol[data] == 0)
    before = _folded(data[at - 1]).astype(np.int32) if len(at) else np.zeros(0, np.int32)
    before[np.isin(at, offsets)] = 0
    return at, before * BYTES + _folded(data[at])


def _context_counts(symbol: np.ndarray, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(languages)}
        totals = [np.zeros(FIRST_REST + BYTES**2, np.int64) for _ in languages]
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1), CHUNK):
                codes = context_codes(data, offsets, symbol)
                owner = np.array([number[x] for x in batch.column(0)[low:high].to_pylist()])
                owner = np.repeat(owner, np.diff(offsets))
                at, rest = rest_codes(data, offsets, symbol)
                for i in np.unique(owner):
                    values, n = np.unique(codes[owner == i], return_counts=True)
                    totals[i][values] += n
                    values, n = np.unique(rest[owner[at] == i], return_counts=True)
                    totals[i][FIRST_REST + values] += n
        for i, name in enumerate(languages):
            at = np.flatnonzero(totals[i])
            for low in range(0, len(at), 100_000):
                part = at[low : low + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part)), pa.array(part, pa.int64()), pa.array(totals[i][part], pa.int64())], ["lang", "code", "n"])

    return run


def code_lengths(counts: np.ndarray, a: int = ALPHABET, longest: int = ORDER) -> np.ndarray:
    """Code length in bits of every (context, symbol) from the counts of the longest contexts."""
    lower = np.full((1, a), 1.0 / a)
    for order in range(longest + 1):
        # Counts of contexts of this order: shorter contexts sum over the further symbols, which lead in the number.
        c = counts.reshape(a ** (longest - order), a**order, a).sum(axis=0).astype(float)
        below = np.tile(lower, (c.shape[0] // lower.shape[0], 1))
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        rest = 1 - np.where(c > 0, below, 0).sum(1, keepdims=True)
        full = distinct == a
        share = np.divide(c, np.where(full, total, total + distinct), out=np.zeros_like(c), where=total > 0)
        escape = np.divide(distinct, total + distinct, out=np.ones_like(total), where=total > 0)
        lower = np.where(c > 0, share, escape * below / np.maximum(rest, 1e-300))
    return -np.log2(lower).reshape(-1)


class Trees:
    """Symbol table, languages and the code lengths of all languages side by side."""

    def __init__(self, symbol: np.ndarray, languages: list[str], lengths: np.ndarray):
        self.symbol, self.languages, self.lengths = symbol, languages, lengths


def learn(docs: DataFrame, usable) -> Trees | None:
    """Trees of all languages in ``lang`` from every usable text: two passes, both summed before the shuffle.

    What reaches the driver is bounded by the tables: 256 byte counts, and per language at most
    ALPHABET ** (ORDER + 1) contexts and 256 ** 2 pairs of bytes.
    """
    known = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(usable(F.col("doc_id")))
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    by_byte = known.select("text").mapInArrow(_byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r["n"], r["byte"]) for r in by_byte.collect() if r["n"]))
    symbol = np.zeros(256, np.uint8)
    for i, (_, byte) in enumerate(ranked[: ALPHABET - 1]):
        symbol[byte] = i + 1
    symbol[65:91] = symbol[97:123]
    counted = known.select("lang", "text").mapInArrow(_context_counts(symbol, languages), "lang string, code long, n long")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    lengths = np.empty((len(languages), FIRST_REST + BYTES**2), np.float32)
    for i, name in enumerate(languages):
        own = counted[counted["lang"] == name]
        counts = np.zeros(FIRST_REST + BYTES**2)
        counts[own["code"].to_numpy()] = own["n"].to_numpy()
        lengths[i, :FIRST_REST] = code_lengths(counts[:FIRST_REST])
        lengths[i, FIRST_REST:] = code_lengths(counts[FIRST_REST:], BYTES, REST_ORDER)
    return Trees(symbol, languages, lengths)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the shortest code, and its share of the posterior.

    Only the text is looked at. Null texts, texts without a letter, and all texts when nothing
    could be learned are ``und`` with score 0. Ties go to the first language in order. The
    posterior weighs code lengths per byte at ``1`` bit apart as a factor of 2 ** 16, so it stays
    comparable between short and long texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    languages = trees.languages if trees else []
    shared = rows.sparkSession.sparkContext.broadcast((trees.symbol, trees.lengths) if trees else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, lengths = shared.value or (None, None)
        letters = np.zeros(256, bool)
        letters[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1), CHUNK):
                names, scores = ["und"] * (high - low), [0.0] * (high - low)
                if languages and len(data):
                    codes = context_codes(data, offsets, symbol)
                    rest_at, rest = rest_codes(data, offsets, symbol)
                    total = np.zeros((high - low, len(languages)))
                    filled = np.flatnonzero(np.diff(offsets))
                    for at in range(len(languages)):
                        column = np.take(lengths[at], codes)
                        column[rest_at] += np.take(lengths[at], FIRST_REST + rest)
                        total[filled, at] = np.add.reduceat(column, offsets[filled], dtype=np.float64)
                    plain = np.logical_or.reduceat(letters[data], offsets[filled])
                    for k, ok in zip(filled.tolist(), plain.tolist()):
                        text = data[offsets[k] : offsets[k + 1]]
                        if ok or ((text >= 128).any() and has_letter(text.tobytes())):
                            bits = 16 * (total[k] - total[k].min()) / len(text)
                            weight = np.exp2(-bits)
                            best = int(np.argmin(total[k]))
                            names[k], scores[k] = languages[best], float(weight[best] / weight.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
