"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by length and numbered; a superstep matches all pieces of one length,
longest first, with their successor gaps: the smallest gaps that hold them. Sequences with
equal gap and history are interchangeable, so a match is between a run of piece ranks and a
block of sequences; the rank of a piece decides which sequence of the block it gets, gaps are
updated block-wise, and the next length follows. This gives exactly the packing of sequential
best-fit decreasing. There are at most ``capacity`` lengths and each match leaves a block less
than half its gap, so the sweep handles some thousand runs whatever the corpus holds, and
pieces find their run by binary search on their rank in the tasks. Token ids never move.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import with_rank
from .hashing import text_chunks

CAPACITY, END_ID = 4096, 1
CACHE_WORDS = 250_000  # distinct runs, and distinct words, that a task remembers


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary shows for each byte: itself, or the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}


class WordIds:
    """Token ids of space-free runs as bytes, each distinct run and word encoded once while the cache has room.

    The tokenizer drops white space and no token crosses it, so runs can be encoded alone. It
    also parts letters from marks: a Latin word between marks of ``MARKS`` is encoded by the
    model itself, in lower case and byte letters, and the marks on either side alone. Every
    other run goes through the whole tokenizer.
    """

    MARKS = '.,!|%$&*#"'

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
        if len(self.words) < CACHE_WORDS:
            self.words[word] = ids
        return ids

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            ids = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
            if len(self.marks) >= CACHE_WORDS:
                return ids
            self.marks[mark] = ids
        return self.marks[mark]

    def _encoded(self, runs: set[str]) -> dict[str, bytes]:
        out, rest, known = {}, [], self.words.get
        for run in runs:
            core = run.strip(self.MARKS)
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and is_normalized("NFC", core) and len(core.lower()) == len(core))):
                word = core.lower()
                ids = known(word) or self._word(word)
                if len(core) != len(run):
                    at = run.index(core)
                    ids = self._mark(run[:at]) + ids + self._mark(run[at + len(core) :])
                out[run] = ids
            else:
                rest.append(run)
        for run, code in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[run] = array("I", code.ids).tobytes()
        return out

    def of(self, words: list[str]) -> dict[str, bytes]:
        """A table that holds at least all of ``words``."""
        wanted = set(words)
        coded = self._encoded(wanted.difference(self.runs))
        if len(self.runs) < CACHE_WORDS:
            self.runs |= coded
            return self.runs
        old = list(wanted.intersection(self.runs))
        coded |= zip(old, map(self.runs.__getitem__, old))
        return coded


def _token_pieces(tokenizer_path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = WordIds(tokenizer_path)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            for low, high, _, _ in text_chunks(batch.column(1)):
                column = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                texts = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in batch.column(1)[low:high].to_pylist()]
                known = ids_of.of([word for words in texts for word in words])
                for doc_id, words in zip(batch.column(0)[low:high].to_pylist(), texts):
                    ids = b"".join(map(known.__getitem__, words)) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        column["doc_id"].append(doc_id)
                        column["piece"].append(piece)
                        column["start"].append(at // 4)
                        column["length"].append(len(part) // 4)
                        column["ids_crc32"].append(zlib.crc32(part))
                        column["ids"].append(part if keep_ids else None)
                yield _piece_batch(column)

    return run


def _piece_batch(column: dict) -> pa.RecordBatch:
    kinds = {"piece": pa.int32(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in column.items()], list(column))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document, each closed by the end id.

    A null or empty text is the end id alone. Documents longer than ``capacity`` are cut into
    full pieces and a rest. ``ids`` is filled (little-endian 32-bit) only on demand.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _token_pieces(tokenizer_path, capacity, keep_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over length classes: (length, pieces, first sequence, pieces a sequence, offset) in rank order.

    Within a run piece r goes to sequence first + r // depth at offset + (r % depth) * length.
    """
    blocks: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    gaps: list[int] = []  # sorted gaps that have blocks
    runs, used = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in blocks:
                bisect.insort(gaps, gap)
            blocks.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = blocks[gap].pop()
                if not blocks[gap]:
                    del blocks[gap]
                    gaps.pop(at)
            else:
                gap, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            depth = gap // length
            full = min(n, left // depth)
            if full:
                runs.append((length, full * depth, first, depth, capacity - gap))
                put(gap - depth * length, first, full)
                left -= full * depth
            rest = min(left, depth) if full < n else 0
            if rest:
                runs.append((length, rest, first + full, depth, capacity - gap))
                put(gap - rest * length, first + full, 1)
                left -= rest
            put(gap, first + full + (rest > 0), n - full - (rest > 0))
    return runs


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: whole pieces, no sequence above ``capacity``, offsets without gaps.

    Needs columns doc_id, piece and length (1..capacity); other columns are carried. Equal rows
    are separate pieces. An empty table gives an empty result.
    """
    numbered = with_rank(materialise(pieces), ["length", "doc_id", "piece"], "__rank")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, firsts = 0, {}
    for length in sorted(counts):
        firsts[length], start = start, start + counts[length]
    rows = []
    for length, n, sequence, depth, offset in best_fit_runs(counts, capacity):
        rows.append((firsts[length], length, sequence, depth, offset))
        firsts[length] += n
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5)
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            first, length, sequence, depth, offset = plan[np.searchsorted(plan[:, 0], rank, "right") - 1].T
            inside = rank - first
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(sequence + inside // depth), pa.array(offset + inside % depth * length)],
                [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")
