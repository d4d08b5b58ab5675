"""Registered queries over files and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as ta
from .common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "long_number": r"\b\d{9,}\b",
    "secret_word": r"(?i)\b(password|api[_-]?key|secret)\b",
    "license": r"(?i)\blicen[cs]e\b",
}


def file_manifest(spark, sf_dir):
    return ta.file_manifest(spark, sf_dir, "*.parquet")


def release_scan(spark, sf_dir):
    return ta.release_scan(table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS)


def column_projection(spark, sf_dir):
    docs = ta.read_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"], label_blind=True)
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# What a release may not hold, by suffix and by name.
SUFFIXES, NAMES = [".php", ".cgi", ".pdf"], ["index.html", "login.html"]


def forbidden_files(spark, sf_dir):
    """Pages as files: the folder part of a URL and a name with one of a few suffixes."""
    pages = table(spark, sf_dir, "pages")
    ends = F.array(*[F.lit(x) for x in (".html", ".PHP", ".pdf", "", ".tar.cgi", "/index.html")])
    name = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.get(ends, (F.col("page_id") % 6).cast("int")))
    found = ta.forbidden_files(pages.select(name.alias("file")), "file", SUFFIXES, NAMES)
    return found.groupBy("rule", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ends")).agg(F.count(F.lit(1)).alias("n"))


_FORBIDDEN = r"""WITH f AS (SELECT regexp_replace(url, '[?#].*$', '') || ['.html', '.PHP', '.pdf', '', '.tar.cgi', '/index.html'][page_id % 6 + 1] AS path FROM pages),
l AS (SELECT path, list_extract(string_split(path, '/'), -1) AS last FROM f),
r AS (SELECT path, 'suffix' AS rule FROM l WHERE lower(regexp_extract(last, '.(\.[^.]*)$', 1)) IN ('.php', '.cgi', '.pdf')
  UNION ALL SELECT path, 'name' FROM l WHERE last IN ('index.html', 'login.html'))
SELECT rule, lower(regexp_extract(path, '\.([^.]*)$', 1)) AS ends, count(*) AS n FROM r GROUP BY ALL"""

_SCAN = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS pattern FROM documents WHERE regexp_matches(text, '{pattern}')" for name, pattern in PATTERNS.items())

QUERIES = {
    "file_manifest": (file_manifest, None),
    "release_scan": (release_scan, _SCAN),
    "forbidden_files": (forbidden_files, _FORBIDDEN),
    "column_projection": (column_projection, "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"),
}
