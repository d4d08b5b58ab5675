"""Removal of byte strings that occur before, by deep-shallow sorting of suffixes.

Every 100-byte string of a text is a suffix position, to be sorted by its first 100 bytes.
Sorting all of them would move a hundred times the corpus, so positions are first dealt by
content: each 100-byte string belongs to its anchor, the 20-byte gram in it with the smallest
hash, and neighbouring positions with the same anchor travel as one segment. Equal strings
have equal anchors, so only segments under the same gram can hold equal strings.

* Segments that are equal as a whole need no sort: all but the first are repeats. That is
  settled in each task before the shuffle (so a line that a third of all texts share is one
  row per task) and then per gram in one sorted stream.
* Grams with different segments, at the ends of repeats, go to the sorter in buckets of about
  ``BUCKET_SEGMENTS``. Multikey sorting, eight bytes at a time, runs to ``SHALLOW`` bytes. Groups
  that still tie are ordered by blind tries: each group is laid along one member, branching depth
  and branching word alone decide the subtree, and only the leaf comparison reads all bytes.
* A gram with more different segments than that (a short line that many texts share, each with
  other neighbours) is taken apart: its 100-byte strings are dealt by their own 128-bit hash. Each
  task passes on the first place of a string only; its later ones are repeats already.

Only text positions are shuffled for segments; their bytes follow for the undecided ones, hashes
instead of bytes for the strings of a gram that is taken apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import sent_if_small
from .hashing import LETTERS, STEP, STEP_BACK, U64, mix, powers, seeds, text_chunks

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1  # grams in a string
SHALLOW = 24
PIECE = 1 << 19  # bytes whose strings are anchored at once
FLUSH = 1 << 20  # segments a task compares among themselves before it passes them on
BUCKET_SEGMENTS = 10_000

# Letter values without case folding; the first are those of ``hashing`` in another order.
BYTES = mix(LETTERS + np.arange(256, dtype=U64))
# Letter values and step of the second hash of a string.
BYTES_2, STEP_2 = seeds(256, 11), int(seeds(1, 12)[0])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, strings, gram hash, segment hash) of every segment in a run of texts."""
    empty = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    if len(data) < LENGTH:
        return empty
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTES[data] * powers(STEP, len(data)), out=total[1:])
    back = powers(STEP_BACK, len(data))
    grams = mix((total[GRAM:] - total[:-GRAM]) * back[: len(data) - GRAM + 1])
    low = (grams & ~U64(PIECE * 4 - 1)) | np.arange(len(grams), dtype=U64)  # ties go to the left
    best = sliding_min(low, SPAN)
    anchor = (best & U64(PIECE * 4 - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(data) - LENGTH + 1
    valid = owner[:n] == owner[LENGTH - 1 :]
    begins = valid.copy()
    begins[1:] &= ~(valid[:-1] & (anchor[1:n] == anchor[: n - 1]) & (owner[1:n] == owner[: n - 1]))
    ends = valid.copy()
    ends[:-1] &= ~(valid[1:] & (anchor[1:n] == anchor[: n - 1]) & (owner[1:n] == owner[: n - 1]))
    start, last = np.flatnonzero(begins), np.flatnonzero(ends)
    count = last - start + 1
    whole = (total[last + LENGTH] - total[start]) * back[start] + count.astype(U64)
    return owner[start], start - offsets[owner[start]], count, grams[anchor[start]], mix(whole)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima towards both ends of blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    room = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    room[: len(x)] = x
    room = room.reshape(blocks, width)
    ahead = np.minimum.accumulate(room, axis=1).ravel()
    behind = np.minimum.accumulate(room[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A very long text in overlapping pieces, each string start in exactly one."""
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        yield at, data[at : at + PIECE + LENGTH - 1]


ROWS = "gram long, whole long, doc_id long, start long, strings int, repeat boolean"


def _row_batch(gram, whole, doc, start, count, repeat) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(start), pa.array(count.astype(np.int32)), pa.array(repeat)],
        ["gram", "whole", "doc_id", "start", "strings", "repeat"])


def _in_order(first: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both hashes and place; in that order, which rows open a pair of hashes and which repeat an earlier place of theirs."""
    order = np.lexsort((start, doc, second, first))
    first, second, doc, start = (c[order] for c in (first, second, doc, start))
    same = np.zeros(len(doc), bool)
    same[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    return order, ~same, same & ((doc != doc[lead]) | (start != start[lead]))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of all texts; those that come later than an equal one among the task's own are marked as repeats."""
    held: list[tuple] = []
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        doc, start, count, gram, whole = (np.concatenate(c) for c in zip(*held))
        order, _, repeat = _in_order(gram, whole, doc, start)
        doc, start, count, gram, whole = (c[order] for c in (doc, start, count, gram, whole))
        # A repeat is decided; it needs no company of its gram any more and is spread over the tasks.
        gram = np.where(repeat, mix(whole + start.astype(U64) + mix(doc.astype(U64))), gram)
        for low in range(0, len(doc), 1 << 16):
            high = low + (1 << 16)
            yield _row_batch(gram[low:high], whole[low:high], doc[low:high], start[low:high], count[low:high], repeat[low:high])

    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1), PIECE):
            ids = batch.column(0)[low:high].to_numpy()
            parts = pieces(data) if len(offsets) == 2 else [(0, data)]
            for at, part in parts:
                text, start, count, gram, whole = segments(part, offsets if len(offsets) > 2 else np.array([0, len(part)]))
                held.append((ids[text], start + at, count, gram, whole))
                size += len(text)
        if size >= FLUSH:
            yield from flushed()
            held, size = [], 0
    if size:
        yield from flushed()


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, segment and place: repeats, and the first of each segment where its gram has several.

    The state is the last gram and segment and one row held back, whatever a gram's size.
    """
    gram = whole = None
    first = held = None  # place of the segment's first row; first row of a gram that has one segment so far
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        # Rows alone under their gram are most; skip all but the outermost of such rows at once.
        g = columns[0]
        alone = np.zeros(len(g), bool)
        alone[1:-1] = (g[1:-1] != g[:-2]) & (g[1:-1] != g[2:]) & ~columns[5][1:-1]
        keep = np.flatnonzero(~alone)
        for row in zip(*(c[keep].tolist() for c in columns)):
            if row[5]:
                out.append((*row[:5], True))
                continue
            if row[0] != gram:
                gram, whole, first, held = row[0], row[1], row[2:4], row
            elif row[1] != whole:
                if held is not None:
                    out.append((*held[:5], False))
                    held = None
                out.append((*row[:5], False))
                whole, first = row[1], row[2:4]
            elif row[2:4] != first:
                out.append((*row[:5], True))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["gram", "whole", "doc_id", "start", "strings", "repeat"])


CUT_ROWS = ROWS + ", bytes binary"


def string_hashes(cut: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, step, hash, second hash) of every 100-byte string of some segments."""
    size = np.array([len(c) for c in cut], np.int64)
    strings = size - LENGTH + 1
    segment = np.repeat(np.arange(len(cut)), strings)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = (np.cumsum(size) - size)[segment] + step
    data = np.frombuffer(b"".join(cut), np.uint8)
    hashes = []
    for letters, base in ((BYTES, STEP), (BYTES_2, STEP_2)):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(letters[data] * powers(base, len(data)), out=total[1:])
        hashes.append(mix((total[at + LENGTH] - total[at]) * powers(pow(base, -1, 1 << 64), len(data))[at]))
    return segment, step, *hashes


def joined_runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, strings) of runs of neighbouring string starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (np.diff(start) != 1)
    return doc[begins], start[begins], np.diff(np.append(np.flatnonzero(begins), len(doc)))


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the undecided segments out of their texts.

    A segment of a gram that is taken apart leaves hashed strings without bytes instead: those
    that are first in the task, and runs of repeats for the rest.
    """
    held: list[tuple] = []
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        doc, start, one, two = (np.concatenate(c) for c in zip(*held))
        order, opens, repeat = _in_order(one, two, doc, start)
        doc, start, one, two = (c[order] for c in (doc, start, one, two))
        again, again_start, strings = joined_runs(doc[repeat], start[repeat])
        spread = mix(again_start.astype(U64) + mix(again.astype(U64)))
        columns = [np.concatenate(c) for c in (
            (one[opens], spread), (two[opens], spread), (doc[opens], again), (start[opens], again_start),
            (np.ones(opens.sum(), np.int64), strings), (np.zeros(opens.sum(), bool), np.ones(len(again), bool)))]
        for low in range(0, len(columns[0]), 1 << 16):
            batch = _row_batch(*(c[low : low + (1 << 16)] for c in columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], [*batch.schema.names, "bytes"])

    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1), PIECE):
            gram, doc, start, count, cut = [], [], [], [], []
            apart: list[tuple] = []
            for k, wanted in enumerate(batch.column(2)[low:high].to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                doc_id = batch.column(0)[low + k].as_py()
                for w in wanted:
                    part = text[w["start"] : w["start"] + w["strings"] + LENGTH - 1].tobytes()
                    if w["apart"]:
                        apart.append((doc_id, w["start"], part))
                        continue
                    gram.append(w["gram"])
                    doc.append(doc_id)
                    start.append(w["start"])
                    count.append(w["strings"])
                    cut.append(part)
            if cut:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram, pa.int64()), pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int32()),
                     pa.array([False] * len(cut)), pa.array(cut, pa.binary())],
                    ["gram", "whole", "doc_id", "start", "strings", "repeat", "bytes"])
            if apart:
                ids, starts, parts = zip(*apart)
                segment, step, one, two = string_hashes(parts)
                held.append((np.array(ids, np.int64)[segment], np.array(starts, np.int64)[segment] + step, one, two))
                size += len(segment)
            if size >= FLUSH:
                yield from flushed()
                held, size = [], 0
    if size:
        yield from flushed()


def equal_classes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For string starts ``at`` in ``data``: a number shared by equal strings of the same group, -1 where alone."""
    words = np.zeros(len(data), U64)
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(8):
        words = (words << U64(8)) | room[j : j + len(data)]
    label = np.full(len(at), -1, np.int64)
    alive = np.arange(len(at))

    def regrouped(alive: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members in groups of equal keys, without the lone ones, and the number of their group."""
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1
        return alive[order][several], number[several]

    for depth in range(0, SHALLOW, 8):  # shallow: multikey sort by whole words
        if len(alive):
            alive, group = regrouped(alive, words[at[alive] + depth], group)
    fresh = 0
    while len(alive):  # deep: one blind-trie level for all groups at a time
        lead = np.ones(len(alive), bool)
        lead[1:] = group[1:] != group[:-1]
        member = at[alive[np.flatnonzero(lead)[np.cumsum(lead) - 1]]]
        branch = np.full(len(alive), LENGTH)
        open_ = np.arange(len(alive))
        for depth in [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]:
            differs = words[at[alive[open_]] + depth] != words[member[open_] + depth]
            branch[open_[differs]] = depth
            open_ = open_[~differs]
        leaf = branch == LENGTH
        label[alive[leaf]] = fresh + group[leaf]
        fresh += int(group.max()) + 1
        rest = ~leaf
        if not rest.any():
            break
        alive, group = regrouped(alive[rest], words[at[alive[rest]] + branch[rest]], branch[rest], group[rest])
    return label


RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("strings", pa.int32())])


def _bucket_repeats(table: pa.Table) -> pa.Table:
    """Runs of strings (doc_id, start, strings) of a bucket that have an earlier place: decided ones, of hashed strings, of segments."""
    decided = table.filter(table["repeat"]).select(RUNS.names)
    table = table.filter(pc.invert(table["repeat"]))
    hashed = table.filter(pc.is_null(table["bytes"]))
    one, two, doc, start = (hashed[c].to_numpy() for c in ("gram", "whole", "doc_id", "start"))
    order, _, repeat = _in_order(one, two, doc, start)
    later = order[repeat]
    runs = pa.table([pa.array(c, k) for c, k in zip(joined_runs(doc[later], start[later]), RUNS.types)], schema=RUNS)
    segments = table.filter(pc.is_valid(table["bytes"]))
    return pa.concat_tables([decided.cast(RUNS), runs, *([_sorted_repeats(segments)] if segments.num_rows else [])])


def _sorted_repeats(table: pa.Table) -> pa.Table:
    """Runs of strings (doc_id, start, strings) that another segment of the bucket has at an earlier place."""
    table = table.combine_chunks()
    cut = table["bytes"].combine_chunks()
    data = np.frombuffer(b"".join(cut.to_pylist()), np.uint8)
    doc, start, count = (table[c].to_numpy() for c in ("doc_id", "start", "strings"))
    length = count.astype(np.int64) + LENGTH - 1
    first = np.cumsum(length) - length
    segment = np.repeat(np.arange(len(doc)), count)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    group = np.unique(table["gram"].to_numpy(), return_inverse=True)[1]
    label = equal_classes(data, first[segment] + step, group[segment])
    tied = np.flatnonzero(label >= 0)
    place, owner = (start[segment] + step)[tied], doc[segment][tied]
    order = np.lexsort((place, owner, label[tied]))
    tied, place, owner = tied[order], place[order], owner[order]
    new = np.ones(len(tied), bool)
    new[1:] = label[tied[1:]] != label[tied[:-1]]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(tied) else np.zeros(0, np.int64)
    later = np.sort(tied[(owner != owner[lead]) | (place != place[lead])])
    begins = np.ones(len(later), bool)
    begins[1:] = (np.diff(later) != 1) | (segment[later[1:]] != segment[later[:-1]])
    head = later[begins]
    size = np.diff(np.append(np.flatnonzero(begins), len(later)))
    return pa.table([pa.array(c, k) for c, k in zip((doc[segment[head]], start[segment[head]] + step[head], size), RUNS.types)], schema=RUNS)


def removed_spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs covered by half-open intervals."""
    out: list[list[int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cleaned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1)):
            spans, kept = [], []
            runs = batch.column(2)[low:high].to_pylist()
            for k, copy in enumerate(batch.column(3)[low:high].to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if copy and len(text) >= LENGTH:
                    gone = [(0, len(text))]
                else:
                    gone = removed_spans([(r["start"], r["start"] + r["strings"] + LENGTH - 1) for r in runs[k] or []])
                left, at = [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join([*left, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[low:high], pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans and the bytes that stay, for every row.

    A byte goes if a string of 100 bytes around it also starts at an earlier place: smaller
    doc_id, or the same and an earlier start. Null and empty texts have no bytes. Rows with
    equal id and text are one place and never remove each other; ids should be unique. Rows
    with a null id have no place: they keep all bytes and remove nothing. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = rows.where("doc_id IS NOT NULL AND octet_length(text) > 0")
    # Whole copies of an earlier text are repeats as a whole, and whatever they hold the first of them holds earlier.
    marked = materialise(placed.select("doc_id", F.unhex(F.md5("text")).alias("md5"), F.octet_length("text").alias("n")))
    classes = marked.groupBy("md5", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    classes = materialise(classes.select("md5", "n", "first"))  # apart from the join, so that Spark can split a text with very many copies
    copies = materialise(marked.join(classes, ["md5", "n"]).where("doc_id <> first").select(F.col("doc_id").alias("copy_id")))
    copies = sent_if_small(copies, 16)
    originals = placed.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")
    dealt = originals.mapInArrow(_segment_rows, ROWS).repartition("gram").sortWithinPartitions("gram", "whole", "doc_id", "start")
    decided = materialise(dealt.mapInArrow(_decided, ROWS))
    undecided = decided.where("NOT repeat")
    crowded = undecided.groupBy("gram").agg(F.count(F.lit(1)).alias("segments")).where(F.col("segments") > BUCKET_SEGMENTS)
    crowded = sent_if_small(materialise(crowded.select("gram", F.lit(True).alias("apart"))), 16)
    marked_segments = undecided.join(crowded, "gram", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    wanted = marked_segments.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "strings", "apart")).alias("wanted"))
    cut = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_bytes_of, CUT_ROWS)
    buckets = max(1, undecided.count() // BUCKET_SEGMENTS)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket_repeats, "doc_id long, start long, strings int")
    runs = decided.where("repeat").select("doc_id", "start", "strings").unionByName(bucketed)
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    final = rows.join(per_doc, "doc_id", "left").join(copies, F.col("doc_id") == F.col("copy_id"), "left")
    return final.select("doc_id", "text", "runs", F.col("copy_id").isNotNull().alias("copy")).mapInArrow(
        _cleaned_rows, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(rows: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) per document, string by string, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc_id in sorted(texts):
        text = texts[doc_id]
        gone = []
        for at in range(len(text) - LENGTH + 1):
            part = text[at : at + LENGTH]
            if part in seen:
                gone.append((at, at + LENGTH))
            seen.add(part)
        spans = removed_spans(gone)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        out[doc_id] = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out
