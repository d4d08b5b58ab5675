"""Every stage of the pipeline against a plain version of its rule, odd rows and clashing names included."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nestgrain.llm import credentials, quality, quality_query
from nestgrain.llm.packing_query import tokenizer_path

FOLD = {i: i + 32 for i in range(65, 91)}
ODD = [(900_001, None), (900_002, ""), (900_003, " \t"), (900_004, "One two"), (900_005, "one TWO"), (900_005, "one TWO"), (None, "no id"), (None, None)]


def plain_score(text, net):
    """The network's score by its definition, one position at a time."""
    data = (text or "").encode()
    n = quality.positions(len(data))
    data = data + bytes(2 * (n - 1) + quality.WIDTH - len(data))
    filters = net.filters.reshape(quality.WIDTH, quality.DIM, quality.FILTERS)
    out = np.array([sum(net.embed[data[2 * p + j]] @ filters[j] for j in range(quality.WIDTH)) for p in range(n)])
    halves = [np.maximum(out[k : k + quality.POOL].max(axis=0) + net.bias, 0) for k in range(0, n, quality.POOL)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    short = max(0.0, 1 - n / (2 * quality.POOL))
    mean = np.mean(chunks, axis=0)
    features = np.concatenate([mean, np.min(chunks, axis=0), np.max(chunks, axis=0), short * mean, [short, short * short]])
    return 1 / (1 + math.exp(-(features @ net.weights + net.constant)))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_near(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    low = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return [(i, t) for i, t in rows if i is None or low[i] == i]


def plain_decontaminated(rows, items):
    items = [s for s in map(shingles, items) if s]
    return [(i, t) for i, t in rows if i is None or not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in items)]


def plain_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            n += 1
            gaps.append(capacity - length)
    return n


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", None, None) for i, t in ODD], own.schema)
    both = own.unionByName(odd)
    for name in ("score", "__text", "__text0", "__id", "__gone", "__label", "__taken", "id", "gram"):
        both = both.withColumn(name, F.lit(name))
    return both.repartition(6).cache()


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_one_after_the_other(spark, sf_dir, docs):
    stages = dict(corpus_pipeline.STAGES)
    columns, now = docs.columns, docs
    net = quality_query.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = [(i, t, plain_score(t, net)) for i, t in rows_of(now)]
    got = stages["quality"](spark, now, sf_dir).cache()
    assert got.columns == columns
    assert all(abs(s - quality.THRESHOLD) > 1e-4 for *_, s in scored)
    assert rows_of(got) == [(i, t) for i, t, s in scored if s >= quality.THRESHOLD]

    now, rows = got, rows_of(got)
    got = stages["near_duplicates"](spark, now, sf_dir).cache()
    assert got.columns == columns and rows_of(got) == plain_near(rows)

    now, rows = got, rows_of(got)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = stages["decontamination"](spark, now, sf_dir).cache()
    assert got.columns == columns and rows_of(got) == plain_decontaminated(rows, items)

    now, rows = got, rows_of(got)
    judge = credentials.Judge(credentials._learned(now))
    got = stages["secrets"](spark, now, sf_dir).cache()
    assert got.columns == columns and rows_of(got) == sorted(((i, None if t is None else credentials.redact(t, judge, "[SECRET]")) for i, t in rows), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None and "[SECRET]" in r["text"])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    lengths = {}
    for i, t in rows_of(got):
        lengths.setdefault(i, []).append(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    packed = stages["packing"](spark, got, sf_dir).collect()
    found, filled, pieces = {}, {}, []
    for r in packed:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.append(r["length"])
    assert found == {i: sum(n) for i, n in lengths.items()}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) == plain_fit(pieces, 4096)


def test_empty_tables(spark, sf_dir, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
