"""Benchmark items inside documents by size-partitioned MinHash containment search.

A short item has a tiny Jaccard similarity to a long document, so the search domain is cut by
size: each class of items (by number of shingles) is compared with sliding windows of every
document that are just large enough to hold an item of that class wherever it starts. Within
such a window containment of 0.75 is a Jaccard similarity of at least 0.19, so an item and a
window that share it agree in one of ``COORDINATES`` minima with probability above 0.9999;
a passage lies in several windows. The class of items up to ``TINY`` shingles uses windows of
one shingle: there a shared minimum is a shared shingle.

Minima of 16-shingle base blocks are computed once per coordinate; longer windows are minima
of those. Every document and item that meet are verified by exact shingle containment over
the whole document. Items are the query side: they are worked off in blocks of bounded size,
each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, seeds, sequences_of, sets_of, text_chunks

WIDTH, COORDINATES, BASE, TINY = 5, 48, 16, 8
ITEM_SHINGLES_PER_BLOCK = 2_000_000  # 16 MB of shingles sent to the tasks at a time
LAST = np.iinfo(np.uint64).max


@dataclass
class SizeClass:
    blocks: int  # window length in base blocks; 0 is the class of single shingles
    tops: list[np.ndarray]  # per coordinate: 65,536 flags by the leading bits of the minima
    minima: list[np.ndarray]  # per coordinate: sorted minima
    owners: list[np.ndarray]  # per coordinate: item index of each


def window_blocks(size: int) -> int:
    """Base blocks of the windows for items of ``size`` shingles: the power of two that always holds one."""
    if size <= TINY:
        return 0
    need, blocks = -(-(size + BASE - 1) // BASE), 2
    while blocks < need:
        blocks *= 2
    return blocks


def size_classes(sets: list[np.ndarray]) -> list[SizeClass]:
    members: dict[int, list[int]] = {}
    for i, items in enumerate(sets):
        if len(items):
            members.setdefault(window_blocks(len(items)), []).append(i)
    factors = seeds(COORDINATES, 5)
    classes = []
    for blocks, rows in sorted(members.items()):
        tops, minima, owners = [], [], []
        for factor in factors:
            if blocks == 0:  # a window of one shingle: the item's minimum is looked up as it stands
                low = np.array([sets[i][np.argmin(sets[i] * factor)] for i in rows], U64)
            else:
                low = np.array([(sets[i] * factor).min() for i in rows], U64)
            order = np.argsort(low, kind="stable")
            flags = np.zeros(65536, bool)
            flags[(low >> U64(48)).astype(np.intp)] = True
            tops.append(flags)
            minima.append(low[order])
            owners.append(np.array(rows)[order])
        if blocks == 0:
            low, own = np.concatenate(minima), np.concatenate(owners)
            pairs = np.unique(np.stack([low, own.astype(U64)]), axis=1)
            tops, minima, owners = [np.logical_or.reduce(tops)], [pairs[0]], [pairs[1].astype(np.int64)]
        classes.append(SizeClass(blocks, tops, minima, owners))
    return classes


def hits(values: np.ndarray, k: int, group: SizeClass) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) whose minima agree in coordinate ``k``."""
    near = np.flatnonzero(group.tops[k][(values >> U64(48)).astype(np.intp)])
    low = np.searchsorted(group.minima[k], values[near], "left")
    count = np.searchsorted(group.minima[k], values[near], "right") - low
    windows = np.repeat(near, count)
    steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return windows, group.owners[k][np.repeat(low, count) + steps]


def candidates(texts: list[np.ndarray], classes: list[SizeClass]) -> set[tuple[int, int]]:
    """(text, item) that share a minimum in some window."""
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return set()
    runs = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: set[tuple[int, int]] = set()
    large = [c for c in classes if c.blocks]
    for group in classes:
        if group.blocks == 0:
            at, item = hits(runs, 0, group)
            found.update(zip(owner[at].tolist(), item.tolist()))
    if not large:
        return found
    counts = -(-sizes // BASE)
    firsts = np.cumsum(sizes) - sizes
    block_owner = np.repeat(np.arange(len(texts)), counts)
    cuts = np.repeat(firsts, counts) + BASE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    for k, factor in enumerate(seeds(COORDINATES, 5)):
        low = np.minimum.reduceat(runs * factor, cuts)
        length = 1
        for group in large:
            while length < group.blocks:
                further = np.full_like(low, LAST)
                if length < len(low):
                    same = block_owner[length:] == block_owner[:-length]
                    further[:-length][same] = low[length:][same]
                low, length = np.minimum(low, further), 2 * length
            at, item = hits(low, k, group)
            found.update(zip(block_owner[at].tolist(), item.tolist()))
    return found


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1)):
            packed = [s.tobytes() for s in sets_of(data, offsets, WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(packed, pa.binary())], ["item_id", "items"])


def _search(ids: list[int], sets: list[np.ndarray], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(sets)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for low, high, data, offsets in text_chunks(batch.column(1)):
                doc_ids = batch.column(0)[low:high].to_pylist()
                texts = list(sequences_of(data, offsets, WIDTH))
                whole: dict[int, np.ndarray] = {}
                for text, item in sorted(candidates(texts, classes)):
                    if text not in whole:
                        whole = {text: np.unique(texts[text])}
                    shared = len(np.intersect1d(whole[text], sets[item], assume_unique=True))
                    if 100 * shared >= percent * len(sets[item]):
                        rows.append((doc_ids[text], ids[item], len(sets[item]), shared))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items with 100 * shared shingles >= percent * item shingles.

    Shingles are distinct runs of five words (runs without ASCII white space, A-Z folded);
    shorter texts are one shingle of all their words, so such an item is found only as a
    whole text. Null, empty and blank items and documents match nothing. Repeated ids give
    repeated rows; a null id is returned as null. Empty tables give an empty result.
    """
    packed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    packed = packed.where("text IS NOT NULL").mapInArrow(_item_rows, "item_id long, items binary").where("octet_length(items) > 0")
    total = packed.agg(F.sum(F.octet_length("items") / 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_SHINGLES_PER_BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = None
    for block in range(blocks):
        part = packed if blocks == 1 else packed.where(F.pmod(F.xxhash64("items"), F.lit(blocks)) == block)
        found = sorted((r["item_id"] is None, r["item_id"] or 0, bytes(r["items"])) for r in part.collect())
        search = _search([None if null else i for null, i, _ in found], [np.frombuffer(b, U64) for *_, b in found], percent)
        hit = rows.mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")
        out = hit if out is None else out.unionByName(hit)
    return out
