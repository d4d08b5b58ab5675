"""op11: the strongest collocations of every language in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table

OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece_id, piece
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (
  SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, piece_id, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
places AS (
  SELECT lang, w AS w1, lead(w, 1) OVER piece_order AS w2, lead(w, 2) OVER piece_order AS w3 FROM words WINDOW piece_order AS (PARTITION BY piece_id ORDER BY i)),
uni AS (SELECT lang, w1 AS p, count(*) AS f FROM places GROUP BY ALL),
bi AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS p, count(*) AS f FROM places WHERE w2 IS NOT NULL GROUP BY ALL),
tri AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS p, count(*) AS f FROM places WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f) AS n FROM uni GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, 1 AS k, l.f AS l, r.f AS r FROM bi c
  JOIN uni l ON l.lang = c.lang AND l.p = c.w1 JOIN uni r ON r.lang = c.lang AND r.p = c.w2 WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.p, c.f, 1, l.f, r.f FROM tri c
  JOIN uni l ON l.lang = c.lang AND l.p = c.w1 JOIN bi r ON r.lang = c.lang AND r.p = c.w2 || ' ' || c.w3
  UNION ALL
  SELECT c.lang, c.p, c.f, 2, l.f, r.f FROM tri c
  JOIN bi l ON l.lang = c.lang AND l.p = c.w1 || ' ' || c.w2 JOIN uni r ON r.lang = c.lang AND r.p = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
covered AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS p, f FROM tri UNION ALL SELECT lang, w2 || ' ' || w3, f FROM tri) GROUP BY ALL),
ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.p) AS rank, w.p AS phrase, a, l, r, score
  FROM worst w LEFT JOIN covered c ON c.lang = w.lang AND c.p = w.p WHERE c.f IS NULL OR 100 * c.f < 50 * w.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": (op11_collocations, OP11_SQL)}
