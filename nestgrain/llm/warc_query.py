"""op1: pages as ARC, converted to WARC, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialise
from .common import table
from .warc import arc_containers, convert_arc, read_warc, write_warc

#: Base 32 by hand: five bits of the digest at a time.
OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
best AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN best ON p.body = best.body"""


def pages_through_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_warc(convert_arc(arc_containers(pages)), path)
    rows = read_warc(spark, path)
    rows = materialise(rows)  # inflated once, read as responses, as revisits and as what those refer to
    responses = rows.where("record_type = 'response'")
    known = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).distinct()
    revisits = rows.where("record_type <> 'response'").join(known, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select(*columns))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_warc(spark, table(spark, sf_dir, "pages"))


QUERIES = {"op1_warc": (op1_warc, OP1_SQL)}
