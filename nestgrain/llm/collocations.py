"""Phrase collocations from sorted count streams.

Phrases are counted length by length. A phrase is frequent only if both phrases that lack one of
its end words are, so tasks count a length after the one before it and skip what a bit table of
the frequent shorter phrases rules out. The table has a fixed size and only ever keeps too much.

The frequent phrases are then one stream of (words, count), laid out twice. In suffix order,
sorted by the words read backwards, every phrase comes after each of its own endings; in prefix
order after each of its own beginnings. One lockstep pass over each layout carries the last count
of every length along and so gives each phrase the counts of all its endings and beginnings, and
shows which of its shorter phrases it covers. No join by key is needed. A layout is range
partitioned, whatever the words; what a slice needs of the slices before it is one count a
length, so a word that begins or ends a third of all phrases is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import sent_if_small, with_rank
from .hashing import mix

FILTER_BITS = 27  # 16 MB, whatever the corpus holds
FLUSH_WORDS = 2 << 20  # words that a task gathers before it counts them
CHUNK_BYTES = 1 << 20
BREAK, EMPTY = 0, 1  # numbers of the end of a piece and of the nothing between two spaces
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_TABLE = bytes(10 if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64


class _Words(dict):
    """Word to its number in this task, in order of first sight."""

    def __init__(self):
        super().__init__({b"\n": BREAK, b"": EMPTY})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _chained(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(hashes * U64(0x9E3779B97F4A7C15) + word)


def _listed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes >> U64(64 - FILTER_BITS)
    return (bits[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1


def _lang_seed(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang)], U64)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _counted(length: int, bits):
    """(lang, phrase, n) for phrases of ``length`` words; for single words also one row (lang, null, all words)."""

    def counts(lang: str, words: _Words, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(parts)
        names = pa.array(list(words), pa.binary())
        whole = codes > EMPTY
        if length == 1:
            n = np.bincount(codes, minlength=len(words))
            n[: EMPTY + 1] = 0
            found = np.flatnonzero(n)
            phrases, counts = names.take(pa.array(found)), n[found]
            yield out_batch(lang, pa.array([None], pa.binary()), np.array([whole.sum()]))
        else:
            hashes = np.fromiter(map(_word_hash, words), U64, len(words))
            table = bits.value
            sub = len(codes) - length + 2  # windows of length - 1
            if sub <= 1:
                return
            good, hashed = whole[:sub].copy(), np.repeat(_lang_seed(lang), sub)
            for k in range(length - 1):
                good &= whole[k : k + sub]
                hashed = _chained(hashed, hashes[codes[k : k + sub]])
            good &= _listed(table, hashed)
            at = np.flatnonzero(good[:-1] & good[1:])
            key = codes[at].astype(np.int64)
            for k in range(1, length):
                known, key = np.unique(key, return_inverse=True) if k > 1 else (None, key)
                key = key << 32 | codes[at + k]
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            at = at[first]
            phrases = pc.binary_join_element_wise(*[names.take(pa.array(codes[at + k])) for k in range(length)], b" ")
        for low in range(0, len(counts), 100_000):
            yield out_batch(lang, phrases[low : low + 100_000], counts[low : low + 100_000])

    def out_batch(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, held = _Words(), {}, 0
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for low in range(0, len(texts), 512):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[low : low + 512].to_pylist(), texts[low : low + 512].to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, group in by_lang.items():
                    joined = (b"\n".join(group) + b"\n").translate(WORD_TABLE).replace(b"\n", b" \n ")
                    codes = np.array(list(map(words.__getitem__, joined.split(b" "))), np.int32)
                    codes = codes[codes != EMPTY]
                    parts.setdefault(lang, []).append(codes)
                    held += len(codes)
                if held >= FLUSH_WORDS:
                    for lang, group in parts.items():
                        yield from counts(lang, words, group)
                    words, parts, held = _Words(), {}, 0
        for lang, group in parts.items():
            yield from counts(lang, words, group)

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit table of phrases as (slot of 64 bits, bits)."""
    for batch in batches:
        hashed = []
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            h = _lang_seed(lang)
            for word in phrase.split(b" "):
                h = _chained(h, np.array([_word_hash(word)], U64))
            hashed.append(h[0])
        cell = np.array(hashed, U64) >> U64(64 - FILTER_BITS)
        slot, bit = (cell >> U64(6)).astype(np.int64), U64(1) << (cell & U64(63))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit.view(np.int64))], ["slot", "bits"])


def _bit_table(frequent: DataFrame):
    """Broadcast bits of all ``frequent`` phrases: at most 2**FILTER_BITS bits reach the driver, in rows of 64."""
    slots = frequent.select("lang", "phrase").mapInArrow(_slots, "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits"))
    found = slots.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _layout(stream: DataFrame, words: Column, lengths: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """``stream`` in the order of ``words`` within a language, and what each slice carries over from those before it."""
    at = stream.withColumn("__order", words).repartitionByRange("lang", "__order").sortWithinPartitions("lang", "__order")
    at = materialise(at.drop("__order").withColumn("__at", F.monotonically_increasing_id()))
    slice_ = F.shiftright("__at", 33)
    last = [F.expr(f"max_by(f, __at) FILTER (WHERE size(words) = {d})").alias(f"f{d}") for d in range(1, lengths)]
    carried, before = {}, [0] * (lengths - 1)
    for row in sorted(at.groupBy(slice_.alias("p")).agg(F.first("__at").alias("a"), *last).collect()):
        carried[row["p"]] = before
        before = [row[f"f{d}"] if row[f"f{d}"] is not None else before[d - 1] for d in range(1, lengths)]
    return at, carried


def _carry(carried: dict[int, list[int]], lengths: int, name: str):
    """Appends ``name``: the last count of every shorter length seen in stream order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = list(carried[batch.column(batch.schema.get_field_index("__at"))[0].as_py() >> 33])
            size = pc.list_value_length(batch.column(batch.schema.get_field_index("words"))).to_numpy(zero_copy_only=False)
            f = batch.column(batch.schema.get_field_index("f")).to_numpy()
            rows = np.arange(len(f))
            seen = np.empty((len(f), lengths - 1), np.int64)
            for d in range(1, lengths):
                last = np.maximum.accumulate(np.where(size == d, rows, -1))
                seen[:, d - 1] = np.where(last >= 0, f[last], state[d - 1])
                state[d - 1] = int(seen[-1, d - 1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * (lengths - 1)), pa.array(seen.ravel()))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "__at"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [lists], [batch.schema.names[i] for i in keep] + [name])

    return run


def frequent_phrases(texts: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases with f >= min_count, and (lang, n) with all words; ``texts`` has lang and text, no nulls."""
    streams, totals, bits = [], None, None
    for length in range(1, max_words + 1):
        # tasks hand on each phrase once or twice, so a hash table before the shuffle would only fill memory
        counted = texts.mapInArrow(_counted(length, bits), "lang string, phrase string, n long").repartition("lang", "phrase")
        counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        counted = materialise(counted.where((F.col("f") >= min_count) | F.col("phrase").isNull()))
        if totals is None:
            totals = counted.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
            counted = counted.where("phrase IS NOT NULL")
        streams.append(counted)
        if length < max_words:
            bits = _bit_table(counted)
    stream = streams[0]
    for other in streams[1:]:
        stream = stream.unionByName(other)
    return stream, totals


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_words`` words of every language.

    A phrase with count a >= ``min_count`` scores floor(1000000·a²/(l·r)) at its worst cut into a
    beginning (count l) and a rest (r); ties go to the shortest beginning. Phrases inside a longer
    one with at least ``cover`` percent of their count are left out. Letters A-Z are lowered;
    phrases never cross . , ; : ! ? or a line end; words part at spaces and tabs. n counts all
    words of the language. A null language counts as ``und``, a null text as an empty one; repeated
    rows count each time; other columns play no part. Without a candidate, or without rows, the
    result is empty. Arithmetic is exact (decimals of 38 digits: counts up to 10**15).
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stream, totals = frequent_phrases(texts, max_words, min_count)
    stream = stream.select("lang", F.split("phrase", " ").alias("words"), "f")
    rows = "lang string, words array<string>, f long"
    at, carried = _layout(stream, F.reverse("words"), max_words)
    stream = at.mapInArrow(_carry(carried, max_words, "rests"), f"{rows}, rests array<long>")
    at, carried = _layout(stream, F.col("words"), max_words)
    stream = materialise(at.mapInArrow(_carry(carried, max_words, "starts"), f"{rows}, rests array<long>, starts array<long>").where("size(words) > 1"))

    covered = F.expr(f"""filter(array(
        IF(100 * f >= {int(cover)} * element_at(starts, size(words) - 1), slice(words, 1, size(words) - 1), NULL),
        IF(100 * f >= {int(cover)} * element_at(rests, size(words) - 1), slice(words, 2, size(words) - 1), NULL)), w -> w IS NOT NULL)""")
    inside = stream.where("size(words) > 2").select("lang", F.explode(covered).alias("words")).distinct()
    cuts = F.expr("""transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', (1000000 * CAST(f AS DECIMAL(16, 0)) * CAST(f AS DECIMAL(16, 0))) div
                 (CAST(element_at(starts, k) AS DECIMAL(16, 0)) * CAST(element_at(rests, size(words) - k) AS DECIMAL(16, 0))),
        'k', k, 'l', element_at(starts, k), 'r', element_at(rests, size(words) - k)))""")
    kept = stream.join(inside, ["lang", "words"], "left_anti").withColumn("cut", F.array_min(cuts))
    kept = materialise(kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    ranked = materialise(with_rank(kept.withColumn("__down", -F.col("score")).withColumn("__few", -F.col("a")), ["lang", "__down", "__few", "phrase"], "__rank"))
    starts = materialise(ranked.groupBy("lang").agg(F.min("__rank").alias("__first")).join(totals, "lang"))
    best = ranked.join(sent_if_small(starts, 64), "lang").withColumn("rank", F.col("__rank") - F.col("__first") + 1).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
