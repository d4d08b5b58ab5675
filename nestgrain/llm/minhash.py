"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

A text is the set of its distinct word shingles. The sketch has ``COORDINATES`` bins and is
filled in rounds: in round i < t every element falls into one hashed bin with a value of the
form (i, hash), in round t + j all elements go to bin j, and each bin keeps its minimum. Bins
that are filled early are filled by the same elements in both of two similar sets, so two
coordinates agree with probability equal to the Jaccard similarity and, since all bins come
from one pass over distinct elements, their sum is concentrated as well as sampling without
replacement. A round runs only for texts that still have an empty bin.

Texts with equal sets are collapsed first (128-bit set fingerprint). Sketch bands bring
candidates together; every link is confirmed on full shingle sets. In a bucket all members
are first compared with the smallest one. Only buckets whose members then still lie in
different components go on, in blocks of bounded size, where all intersections are counted
exactly. Hot buckets are split into pairs of blocks; nothing is capped.

With four rows and 32 bands a pair at similarity 0.75 is missed with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import components, sent_if_small
from .hashing import STEP, U64, mix, seeds, sets_of, text_chunks

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
WIDTH = 5
BLOCK_MEMBERS = 256
EMPTY = np.iinfo(np.uint64).max


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One sketch per set, by rounds over the texts that still have an empty bin; an empty set keeps all bins empty."""
    t = COORDINATES
    out = np.full(len(sets) * t, EMPTY, U64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, U64)
    factors = seeds(2 * t, 3)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items * factors[i] + U64(i))
        bins = (h >> U64(57)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (U64(i) << U64(56)) | ((h << U64(7)) >> U64(8)))
        open_text = (out.reshape(-1, t) == EMPTY).any(axis=1)
        keep = open_text[owner]
        owner, items = owner[keep], items[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sketch), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(sketch), band, U64)
        for row in range(ROWS):
            key = mix(key * U64(STEP) + sketch[:, band * ROWS + row])
        keys[:, band] = key
    return keys


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1)):
            sets = list(sets_of(data, offsets, WIDTH))
            keys = band_keys(sketches(sets))
            prints = np.array([[mix(s).sum(dtype=U64), mix(s ^ U64(STEP)).sum(dtype=U64)] for s in sets], U64).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[low:high], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), bands],
                ["doc_id", "n_shingles", "f1", "f2", "bands"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_chunks(batch.column(1)):
            packed = [s.tobytes() for s in sets_of(data, offsets, WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(packed, pa.binary())], ["id", "items"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _linked_in_blocks(percent: int):
    """Per pair of blocks: links between members of different components, a spanning set of them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comps = group["id"].to_numpy(), group["component"].to_numpy()
        sides = group["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in group["items"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        shared_by = np.bincount(code, minlength=len(values))
        common = shared_by[code] > 1
        code, owner = code[common], owner[common]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        kept, code = np.unique(code, return_inverse=True)
        for low in range(0, len(kept), 4096):
            part = (code >= low) & (code < low + 4096)
            member = np.zeros((len(sets), min(4096, len(kept) - low)), np.float32)
            member[owner[part], code[part] - low] = 1
            inter += member @ member.T
        union = sizes[:, None] + sizes[None, :] - inter
        good = (100 * inter >= percent * union) & (comps[:, None] != comps[None, :]) & (ids[:, None] < ids[None, :])
        if (sides == 1).any():
            good &= sides[:, None] != sides[None, :]
        x, y = np.nonzero(good)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        a, b = [], []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = root(int(comps[i])), root(int(comps[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Links texts whose distinct 5-word shingle sets have 100 * intersection >= percent * union;
    ``component_id`` is the smallest id reachable. Words are runs without ASCII white space,
    A-Z folded. A text of fewer than five words is one shingle of all of them. Null, empty and
    blank texts have no shingles and link with nothing. Ids are unique integers; a row whose id
    is null cannot be named and comes back as its own group with null ids and kept = true. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sketched = materialise(rows.mapInArrow(_sketch_rows, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialise(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    links = _links(rows, classes, percent)
    joined = classes.select("f1", "f2", "n_shingles", "rep").join(components(links, "a", "b"), F.col("rep") == F.col("node"), "left")
    joined = joined.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "f1", "f2").join(joined, ["f1", "f2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _buckets(banded: DataFrame) -> DataFrame:
    """(lead, members, s1, s2, key) of every set of at least two ids (id, key) that some key brings together."""
    mark = F.xxhash64("id")
    buckets = banded.groupBy("key").agg(
        F.min("id").alias("lead"), F.count(F.lit(1)).alias("members"), F.sum(mark.cast("decimal(38,0)")).alias("s1"), F.bit_xor(mark).alias("s2"))
    # Bands often bring the same members together again: one bucket of each member set is enough.
    return buckets.where("members > 1").groupBy("lead", "members", "s1", "s2").agg(F.min("key").alias("key"))


def _links(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Enough verified links (a, b) between class representatives to connect every component."""
    banded = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    buckets = _buckets(banded)
    members = materialise(banded.join(buckets.select("key", "lead", "members"), "key"))
    needed = materialise(members.select("id").distinct())
    texts = rows.where(F.col("doc_id").isNotNull()).join(sent_if_small(needed, 16), F.col("doc_id") == F.col("id"), "left_semi")
    sets = materialise(texts.mapInArrow(_set_rows, "id long, items binary"))
    lead_sets = sets.select(F.col("id").alias("lead"), F.col("items").alias("lead_items"))
    pairs = members.where("id <> lead").select("lead", "id").distinct()
    pairs = pairs.join(lead_sets, "lead").join(sets, "id").select("lead", "id", "lead_items", "items")
    star = materialise(pairs.mapInArrow(_verified(percent), "a long, b long"))
    found = components(star, "a", "b")
    labelled = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "members", F.coalesce("component", "id").alias("component"))
    labelled = materialise(labelled)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_rows = labelled.join(mixed, "key", "left_semi")
    # A bucket of at most BLOCK_MEMBERS is one group; a larger one becomes every pair of its blocks.
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), blocks).cast("int")
    dealt = open_rows.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    cross = dealt.join(sets, "id").groupBy("key", "i", "j").applyInArrow(_linked_in_blocks(percent), "a long, b long")
    return star.unionByName(cross)
