"""Archives, vectors, the pipeline and its rows against brute-force versions."""

import base64
import hashlib
import math
import uuid

import numpy as np
import pytest

from nestgrain.llm import vectors, warc
from nestgrain.llm.warc_query import pages_through_warc


def test_pages_through_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", None, "", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "<p>a</p>", "x" * 3_000_000, "<p>a</p>"]
    rows = [(i, f"http://a b/\n{i}", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", "y"), (5, "http://again", "<p>a</p>", "z")]
    got = pages_through_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string, head string")).collect()
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        top = best[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pages_through_warc(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions_and_damage():
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    for version in (b"1", b"2"):
        about = version + b" 0 x\n" + warc.ARC_TITLES[version] + b"\n"
        content = warc.arc_record(b"1", b"filedesc://x", b"text/plain", about, warc.CRAWLED, b"x") + warc.arc_record(version, b"http://u", b"text/html", body, "19990203040506", b"x")
        ((fields, got),) = warc.parse_arc(content)
        assert got == body and fields["date"] == b"19990203040506" and len(fields) == len(warc.ARC_FIELDS[version])
        for bad in (content[:-4], content.replace(b" 19990203040506 ", b" 1999x "), content[50:]):
            with pytest.raises(ValueError):
                list(warc.parse_arc(bad))


def test_arc_lines_as_found():
    """Spaces in addresses and types, and short dates."""
    line = b"http://a/b c 1.2.3.4 d 127.0.0.1 199902030405 text/html; charset=utf-8 2"
    for version, tail in ((b"1", b""), (b"2", b" 200 AB= - 77 x.arc")):
        about = version + b" 0 x\n" + warc.ARC_TITLES[version] + b"\n"
        top = warc.arc_record(b"1", b"filedesc://x", b"text/plain", about, warc.CRAWLED, b"x")
        body = line[: -2] + tail + b" 2\r\nhi\n" if tail else line + b"\nhi\n"
        ((fields, got),) = warc.parse_arc(top + body)
        assert got == b"hi" and fields["url"] == b"http://a/b c 1.2.3.4 d" and fields["mime"] == b"text/html; charset=utf-8"
        assert warc.warc_date(fields["date"].decode()) == "1999-02-03T04:05:00Z"
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z" and warc.warc_date("19990203040506") == "1999-02-03T04:05:06Z"


def test_warc_files_are_valid(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "one")], "page_id long, url string, html string")
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write_warc(warc.convert_arc(warc.arc_containers(pages)), path)
    content = [r.content for r in spark.read.format("binaryFile").load(path).collect()]
    records = [r for c in content for r in warc.parse_warc(warc._inflated(memoryview(c)))]
    kinds = sorted(warc.header(head, b"WARC-Type") for head, _ in records)
    assert kinds == [b"response", b"revisit"]
    for head, block in records:
        assert warc.header(head, b"WARC-Block-Digest") == b"sha1:" + warc.base32_sha1(block).encode()
        assert warc.header(head, b"WARC-Date") == b"2000-01-01T00:00:00Z"
    small = str(tmp_path / uuid.uuid4().hex)
    warc.write_warc(warc.convert_arc(warc.arc_containers(pages)), small, least_bytes=10)
    assert warc.read_warc(spark, small).where("record_type = 'revisit'").count() == 0


def brute_links(rows, threshold):
    usable = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    links = {(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b])
             and usable[a] @ usable[b] / (np.linalg.norm(usable[a]) * np.linalg.norm(usable[b])) >= threshold}
    label = {i: i for i, _ in rows}
    for _ in rows:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {i: (sum(i in pair for pair in links), label[i], label[i] == i) for i, _ in rows}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WINDOW", 4)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(240):
        centre = centres[0] if k < 90 else centres[rng.integers(12)]
        rows.append((k, (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).tolist()))
    rows += [(300 + k, rows[0][1]) for k in range(40)] + [(400, [2 * x for x in rows[1][1]]), (401, None), (402, []), (403, [0.0] * 16), (404, [None] + [1.0] * 15)]
    rows += [(405, [math.nan] + [1.0] * 15), (406, [math.inf] + [1.0] * 15), (407, [1.0, 2.0]), (408, [2.0, 4.0]), (409, [1e200] * 16), (410, [1e-200] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    want = brute_links(rows, 0.95)
    assert got == want
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 401")).collect()[0].kept


def test_passes_follow_from_the_bound():
    for n in (10, 10_000, 10**9):
        bits = vectors.prefix_bits(n)
        together = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - together) ** vectors.passes_for(bits, 0.95) <= vectors.MISS


