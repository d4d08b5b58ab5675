"""License texts by template markup compiled into token automata.

A template is wording with regions: ``<<opt>> words <</opt>>`` may be left out, ``<<num>>`` is
one word of digits, ``<<any>>`` is any one word, ``<<var:n>>`` one to ``n`` of them, and ``<<var>>`` stands for one or more words of
any kind, as many as its paragraph holds (a blank line ends a paragraph). It is compiled into a
nondeterministic automaton over words whose states are positions in the template; an optional
region is an edge that jumps over it and a replaceable one an edge back to itself. A place in a
text is accepted when the mandatory wording matches word for word. Words are runs of letters
and digits with A-Z folded, so punctuation and spacing never matter. Every template starts with
a mandatory word, and only places where that word stands are tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_chunks, word_spans

# The phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License texts and notices as templates, and their labels.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "<<opt>> <<num>> <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = ("<<opt>> <<num>> <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
          "in the documentation and or other materials provided with the distribution")
_BSD_3 = ("<<opt>> <<num>> <</opt>> neither the name of <<var>> may be used to endorse or promote products derived from this software without specific prior written permission")
_GNU = ("general public license as published by the free software foundation <<opt>> either <</opt>> version <<num>> <<opt>> <<num>> <</opt>> "
        "<<opt>> of the license <</opt>> <<opt>> or at your option any later version <</opt>>")
_CC = "creative commons attribution {terms} <<opt>> <<num>> <<num>> <</opt>> <<opt>> international <</opt>> <<opt>> unported <</opt>> <<opt>> generic <</opt>> license"
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<opt>> version <</opt>> 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "released under the <<opt>> terms of the <</opt>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
            "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
            "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
            "permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software " + _AS_IS),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
            "notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", f"{_BSD} {_BSD_1} {_BSD_2}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3}"),
    ("gpl", "licensed under the <<opt>> terms of the <</opt>> gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general public license "
            "<<opt>> version <<any>> <</opt>>"),
    ("gpl", f"gnu {_GNU}"), ("lgpl", f"gnu lesser {_GNU}"), ("lgpl", f"gnu library {_GNU}"), ("agpl", f"gnu affero {_GNU}"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public license version 1 1 the license you may not use this file except in compliance with the license"),
    ("epl-2.0", "eclipse public license <<opt>> version <</opt>> <<opt>> v <</opt>> 2 0"),
    ("epl-1.0", "eclipse public license v1 0"),
    ("unlicense", "unencumbered software released into the public domain"),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
             "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
             "redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", "boost software license version 1 0"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "fuck you want to public license"),
    ("artistic-2.0", "artistic license 2 0"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("cc-by", _CC.format(terms="")),
    ("cc-by-sa", _CC.format(terms="sharealike")), ("cc-by-sa", _CC.format(terms="share alike")),
    ("cc-by-nd", _CC.format(terms="noderivatives")), ("cc-by-nd", _CC.format(terms="no derivatives")), ("cc-by-nd", _CC.format(terms="noderivs")),
    ("cc-by-nc", _CC.format(terms="noncommercial")), ("cc-by-nc", _CC.format(terms="non commercial")),
    ("cc-by-nc-sa", _CC.format(terms="noncommercial sharealike")), ("cc-by-nc-nd", _CC.format(terms="noncommercial noderivatives")),
    ("cc-by-nc-nd", _CC.format(terms="noncommercial noderivs")),
    ("cc-by-nc", "licensed under cc by nc <<opt>> <<any>> 0 <</opt>>"),
    ("cc-by-sa", "licensed under cc by sa <<opt>> <<num>> <<num>> <</opt>>"),
    ("cc0", "dedicated to the public domain"),
    ("cc0", "cc0 1 0 universal"),
    ("copyright", "copyright <<opt>> c <</opt>> <<var>> all rights reserved"),
)

WORD_BREAKS = np.ones(256, bool)
WORD_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


ANY, NUMBER = object(), object()
PARAGRAPHS = re.compile(rb"\n[ \t\r]*\n")


class TextWords:
    """Words of one folded text by number, cut when asked for, and the paragraph each stands in."""

    def __init__(self, text: bytes, starts: np.ndarray):
        self.text, self.starts, self.known = text, starts, {}
        self.breaks: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, at: int) -> bytes:
        if at not in self.known:
            self.known[at] = WORDS.match(self.text, int(self.starts[at])).group()
        return self.known[at]

    def same_paragraph(self, at: int) -> bool:
        """Whether word ``at`` stands in the paragraph of the word before it."""
        if self.breaks is None:
            ends = np.array([m.start() for m in PARAGRAPHS.finditer(self.text)], np.int64)
            self.breaks = np.unique(np.searchsorted(self.starts, ends))
        place = np.searchsorted(self.breaks, at)
        return not (place < len(self.breaks) and self.breaks[place] == at)


@dataclass
class Automaton:
    """States 0..n; per state the word it needs (or ANY, NUMBER), where it goes without reading, and whether it may read on."""

    label: str
    words: list
    skips: list[list[int]]
    loops: set[int]

    @property
    def last(self) -> int:
        return len(self.words)

    def closure(self, states: set[int]) -> set[int]:
        waiting, seen = list(states), set(states)
        while waiting:
            for to in self.skips[waiting.pop()]:
                if to not in seen:
                    seen.add(to)
                    waiting.append(to)
        return seen

    def _reads(self, state: int, words: TextWords, at: int) -> bool:
        need = self.words[state]
        if need is ANY:
            return words.same_paragraph(at)
        return words.word(at).isdigit() if need is NUMBER else words.word(at) == need

    def longest(self, words: TextWords, at: int) -> int | None:
        """Word after the longest accepted run that starts at ``at``, or None."""
        states, end = self.closure({0}), None
        while states:
            if self.last in states:
                end = at
            if at == len(words):
                break
            read = [s for s in states if s < self.last and self._reads(s, words, at)]
            states = self.closure({s + 1 for s in read} | {s for s in read if s in self.loops})
            at += 1
        return end


def compiled(label: str, template: str) -> Automaton:
    words: list = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    loops: set[int] = set()
    for token in template.split():
        if token == "<<opt>>":
            opened.append(len(words))
        elif token == "<</opt>>":
            jumps.append((opened.pop(), len(words)))
        elif token in ("<<var>>", "<<any>>"):
            loops |= {len(words)} if token == "<<var>>" else set()
            words.append(ANY)
        elif token == "<<num>>":
            words.append(NUMBER)
        elif token.startswith("<<var:"):
            n, first = int(token[6:-2]), len(words)
            words += [ANY] * n
            jumps += [(first + k, first + n) for k in range(1, n)]
        elif token.startswith("<<"):
            raise ValueError(f"unknown region {token}")
        else:
            words.append(token.encode())
    skips: list[list[int]] = [[] for _ in range(len(words) + 1)]
    for a, b in jumps:
        skips[a].append(b)
    if opened or not words or not isinstance(words[0], bytes) or skips[0]:
        raise ValueError(f"a template needs closed regions and a mandatory first word: {template!r}")
    return Automaton(label, words, skips, loops)


class Library:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases]
        self.automata = [compiled(label, text) for label, text in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for automaton in self.automata:
            self.starts.setdefault(automaton.words[0], []).append(automaton)
        firsts = {p[0] for p, _ in self.phrases} | set(self.starts)
        # Places of a first word as a whole word; the text outside them is never cut into strings.
        self.first = re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + b"|".join(sorted(map(re.escape, firsts))) + rb")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])")

    def find(self, text: bytes, starts: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Base places (word, label) and template matches (word, word after, label) in folded bytes with these word starts.

        A place is one match a label, its longest.
        """
        base, matches = [], []
        words = TextWords(text, starts)
        for place in self.first.finditer(text):
            at = int(np.searchsorted(starts, place.start()))
            for phrase, label in self.phrases:
                if at + len(phrase) <= len(words) and all(words.word(at + k) == word for k, word in enumerate(phrase)):
                    base.append((at, label))
            ends: dict[str, int] = {}
            for automaton in self.starts.get(words.word(at), ()):
                if (end := automaton.longest(words, at)) is not None:
                    ends[automaton.label] = max(end, ends.get(automaton.label, 0))
            matches += [(at, end, label) for label, end in ends.items()]
        return base, matches


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, matches) for every row.

    ``base`` are all places of the fixed phrases as (word, label), ``matches`` the accepted
    template places as (word, end, label), words counted from 0. A null or empty text has no
    words and no places; an empty table gives an empty result; repeated rows are scanned each, a
    null id is returned as null; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library()
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        match_type = pa.list_(pa.struct([("word", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                starts, _ = word_spans(data, offsets, WORD_BREAKS)
                bounds = np.searchsorted(starts, offsets)
                base, matches = [], []
                for k in range(high - low):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().lower()
                    places, found = library.find(text, starts[bounds[k] : bounds[k + 1]] - offsets[k])
                    base.append([{"word": w, "label": label} for w, label in places])
                    matches.append([{"word": w, "end": e, "label": label} for w, e, label in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(np.diff(bounds).astype(np.int64)), pa.array(base, base_type), pa.array(matches, match_type)],
                    ["doc_id", "n_words", "base", "matches"])

    return rows.mapInArrow(
        run, "doc_id long, n_words long, base array<struct<word: long, label: string>>, matches array<struct<word: long, end: long, label: string>>")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and labels; the score is the share of places (base and template) that a template accepted, 0 without places."""

    def names(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    base, matches = F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    places = F.size("base") + F.size("matches")
    score = F.when(places > 0, F.size("matches") / places).otherwise(0.0)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, matches)).alias("labels"), score.cast("double").alias("score"))
