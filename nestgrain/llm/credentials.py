"""Secret scan: fixed patterns, and formats learned from them by grammar inference.

The fixed patterns label credentials. From a bounded sample of them (``MAX_TRAIN_VALUES``
distinct values per kind, smallest hashes) one probabilistic automaton per kind is inferred:
a prefix tree of the values is folded up by merging states whose outgoing and ending
frequencies are statistically compatible (Hoeffding bound). All other candidates of every
document, the unbroken runs of eight or more characters of the credential alphabet and the parts
of such runs beside fixed spans, are scored by how likely the automata emit them, per symbol and
against the letter statistics (classes in threes) of all texts. A candidate at least as likely as all but the
weakest ``TAIL`` of an automaton's own training values, and likelier than the background,
becomes a ``format`` span. Symbols are character classes, so a format is learned, not the
values. Texts are read twice, once to learn and once to judge; no candidate is stored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
LEAST = 8
MAX_TRAIN_VALUES, ALPHA, TAIL = 400, 0.05, 0.01
CACHE_VALUES = 200_000  # verdicts that a task remembers
# Symbol classes: digits, a-f, g-z, A-F, G-Z, the others of the credential alphabet, anything else.
CLASS_SIZES = (10, 6, 20, 6, 20, 6, 188)
OTHER, TRIPLES = 6, len(CLASS_SIZES) ** 3


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    for members, number in ((b"0123456789", 0), (b"abcdef", 1), (b"ghijklmnopqrstuvwxyz", 2), (b"ABCDEF", 3),
                            (b"GHIJKLMNOPQRSTUVWXYZ", 4), (b"+/_.=-", 5)):
        table[list(members)] = number
    return table


CLASSES = _class_table()


def symbols(value: str) -> list[int]:
    return CLASSES[np.frombuffer(value.encode(), np.uint8)].tolist()


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, in order of start and then kind.

    Runs below the minimum length of ``access`` and ``hex`` would be dropped whole, so asking
    for that length in the pattern finds the same matches.
    """
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of every run, or of what fixed spans leave of it, of at least LEAST characters."""
    found, spans = [], sorted((start, end) for start, _, end, _ in taken)
    first = 0
    for m in CANDIDATE.finditer(text):
        at, stop = m.span()
        while first < len(spans) and spans[first][1] <= at:
            first += 1
        for start, end in spans[first:]:
            if start >= stop:
                break
            if start - at >= LEAST:
                found.append((at, start, text[at:start]))
            at = max(at, end)
        if stop - at >= LEAST:
            found.append((at, stop, text[at:stop]))
    return found


def _labelled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least-hashed distinct credentials of each kind in this task, and the counts of its letter classes in threes."""
    kept: list[dict[str, int]] = [{}, {}, {}]
    classes = np.zeros(TRIPLES, np.int64)

    def trim() -> None:
        for kind, values in enumerate(kept):
            if len(values) > MAX_TRAIN_VALUES:
                kept[kind] = dict(sorted(values.items(), key=lambda v: (v[1], v[0]))[:MAX_TRAIN_VALUES])

    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            for _, kind, _, secret in base_spans(text):
                kept[kind][secret] = xxhash.xxh3_64_intdigest(secret) >> 1
            seen = np.concatenate([[OTHER, OTHER], CLASSES[np.frombuffer(text.encode(), np.uint8)]]).astype(np.int64)
            classes += np.bincount((seen[:-2] * len(CLASS_SIZES) + seen[1:-1]) * len(CLASS_SIZES) + seen[2:], minlength=TRIPLES)
        trim()
    rows = [(kind, value, turn, 0) for kind, values in enumerate(kept) for value, turn in values.items()]
    rows += [(-1, str(k), 0, int(n)) for k, n in enumerate(classes) if n]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["kind", "value", "turn", "n"])


class Automaton:
    """Probabilistic automaton merged from a prefix tree: per state how often it ends and where symbols lead."""

    def __init__(self, values: list[list[int]], alpha: float = ALPHA):
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        for value in values:
            at = 0
            self.seen[0] += 1
            for s in value:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.ends)
                    self.ends.append(0), self.seen.append(0), self.next.append({}), self.count.append({})
                self.count[at][s] = self.count[at].get(s, 0) + 1
                at = self.next[at][s]
                self.seen[at] += 1
            self.ends[at] += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.slack * (n**-0.5 + m**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        waiting = [(red, blue)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(s, 0), n, self.count[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    waiting.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` into ``red``."""
        waiting = [(red, blue)]
        while waiting:
            a, b = waiting.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for s, child in self.next[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + self.count[b][s]
                if s in self.next[a]:
                    waiting.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _merge_all(self) -> None:
        red = [0]
        known = {0}
        while True:
            edge = next(((r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in known), None)
            if edge is None:
                break
            parent, s = edge
            blue = self.next[parent][s]
            for r in red:
                if self._compatible(r, blue):
                    self.next[parent][s] = r
                    self._fold(r, blue)
                    break
            else:
                red.append(blue)
                known.add(blue)

    def score(self, value: list[int]) -> float:
        """Mean log2 likelihood of a symbol, classes spread evenly over their characters; -inf outside the language."""
        at, total = 0, 0.0
        for s in value:
            if s not in self.next[at]:
                return -math.inf
            total += math.log2(self.count[at][s] / self.seen[at] / CLASS_SIZES[s])
            at = self.next[at][s]
        return total / len(value) if self.ends[at] else -math.inf


class Formats:
    """Automata of all kinds with their thresholds, and the background of all texts."""

    def __init__(self, values: dict[int, list[str]], classes: list[int]):
        self.models = []
        for kind in sorted(values):
            coded = [symbols(v) for v in values[kind]]
            model = Automaton(coded)
            scores = sorted(model.score(v) for v in coded)
            self.models.append((model, scores[int(TAIL * len(scores))]))
        table = np.array(classes, float).reshape(-1, len(CLASS_SIZES)) + 1
        self.background = np.log2(table / table.sum(axis=1, keepdims=True) / np.array(CLASS_SIZES)).tolist()

    def plain(self, coded: list[int]) -> float:
        """Mean log2 likelihood of a symbol in ordinary text, given the two before it; a run begins after other characters."""
        before = [OTHER, OTHER, *coded]
        return sum(self.background[a * len(CLASS_SIZES) + b][c] for a, b, c in zip(before, before[1:], coded)) / len(coded)

    def accepts(self, value: str) -> bool:
        coded = symbols(value)
        scores = [score for model, floor in self.models if (score := model.score(coded)) >= floor]
        return bool(scores) and max(scores) > self.plain(coded)


class Judge:
    """Format verdicts of one task, each distinct value judged once while there is room."""

    def __init__(self, formats: Formats):
        self.formats, self.known = formats, {}

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        found = []
        for start, end, value in candidate_spans(text, base):
            good = self.known.get(value)
            if good is None:
                good = self.formats.accepts(value)
                if len(self.known) < CACHE_VALUES:
                    self.known[value] = good
            if good:
                found.append((start, end))
        return found


def _learned(docs: DataFrame) -> Formats:
    """Automata and background of all texts: one pass, of which a bounded sample and a row of counts reach the driver."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_labelled_rows, "kind int, value string, turn long, n long")
    distinct = rows.groupBy("kind", "turn", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("kind").orderBy("turn", "value")
    sample = distinct.withColumn("__n", F.row_number().over(order)).where((F.col("__n") <= MAX_TRAIN_VALUES) | (F.col("kind") < 0)).collect()
    values: dict[int, list[str]] = {}
    classes = [0] * TRIPLES
    for row in sorted(sample, key=lambda r: (r["kind"], r["turn"], r["value"])):
        if row["kind"] < 0:
            classes[int(row["value"])] = row["n"]
        else:
            values.setdefault(row["kind"], []).append(row["value"])
    return Formats(values, classes)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in code points, in order of start and then kind.

    ``base`` are the fixed patterns, ``spans`` those and the learned formats. A null or empty
    text has none; an empty table gives an empty result. Repeated rows are scanned each; a null
    id is returned as null; other columns are ignored.
    """
    formats = _learned(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(formats)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                found = [(s, k, e) for s, k, e, _ in base] + [(s, 3, e) for s, e in own.spans(text, base)]
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = rows.mapInArrow(judge, "doc_id long, spans array<struct<start: long, kind: int, end: long>>")
    return judged.select("doc_id", F.filter("spans", lambda x: x["kind"] < 3).alias("base"), "spans")


def redact(text: str, judge: Judge, mark: str) -> str:
    base = base_spans(text)
    spans = [(s, e) for s, _, e, _ in base] + judge.spans(text, base)
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` in ``text`` replaced by ``mark``, overlapping spans by one; all rows kept.

    Same columns and types; ``n_chars``, where there is one, is the new length of a changed
    text. The formats are learned from ``docs``; each text is then scanned where it stands, so
    no text is moved and repeated or null ids make no difference. Null texts stay null.
    """
    formats = _learned(docs)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(formats)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = part.column(at).to_pylist()
                clean = [None if t is None else redact(t, judge, mark) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(clean, columns[at].type)
                if size is not None:
                    lengths = [n if c == t else len(c) for n, t, c in zip(columns[size].to_pylist(), texts, clean)]
                    columns[size] = pa.array(lengths, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(rows: DataFrame) -> DataFrame:
    """The counts and digests of ``scan``'s spans."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(k: int):
        return F.filter("base", lambda x: x["kind"] == k)  # a second parameter would be the place in the array

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
