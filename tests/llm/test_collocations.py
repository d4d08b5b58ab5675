"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest

from nestgrain.llm import collocations as co


def brute(rows, max_words, min_count, top, cover):
    grams, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                grams.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {g: f for g, f in grams.items() if len(g[1]) > 1 and f >= min_count}
    out = {}
    for (lang, p), a in cands.items():
        if any(len(q) > len(p) and m == lang and 100 * f >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (m, q), f in cands.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (grams[lang, p[:k]] * grams[lang, p[k:]]), k, grams[lang, p[:k]], grams[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def made(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "état", "x\x01y", "x", "Ünder", "b-c", "q"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 30)))) for _ in range(n)]
    return rows + [("en", "zig zag zoom.") for _ in range(12)] + [("fr", None), (None, ""), ("en", "   "), ("de", "..")]


@pytest.fixture
def table_of(spark):
    return lambda rows: spark.createDataFrame([(i, *r, 1.0, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, score double, phrase string")


@pytest.mark.parametrize("max_words,min_count,top,cover", [(3, 10, 2000, 50), (4, 3, 25, 40), (2, 5, 10, 50)])
def test_equals_brute_force(table_of, max_words, min_count, top, cover):
    rows = made(300)
    got = co.collocations(table_of(rows), max_words, min_count, top, cover).collect()
    want = brute(rows, max_words, min_count, top, cover)
    assert len(got) == len(want) > 10 and {tuple(r) for r in got} == want


def test_small_flushes_and_a_full_filter(table_of, monkeypatch):
    """Counting in small parts and a filter without use change nothing."""
    rows = made(120, 9)
    monkeypatch.setattr(co, "FLUSH_WORDS", 200)
    monkeypatch.setattr(co, "_listed", lambda bits, hashes: hashes == hashes)
    got = co.collocations(table_of(rows), 3, 4, 50, 50).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 4, 50, 50)


def test_one_hot_word(table_of, spark):
    """A word that begins all phrases is spread over the slices of the layout."""
    rng = random.Random(1)
    rows = [("en", f"hot w{rng.randrange(40)} v{rng.randrange(3)}") for _ in range(3000)]
    got = co.collocations(table_of(rows)).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 10, 2000, 50)


def test_nothing_to_find(table_of):
    assert co.collocations(table_of([])).collect() == []
    assert co.collocations(table_of([("en", "a b c")] * 9 + [(None, None)])).collect() == []
