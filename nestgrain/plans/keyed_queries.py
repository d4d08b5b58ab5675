"""Registered queries: composite-key joins, precedence, re-validation, many-field matches, correlation gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.numeric import stable
from ..operators import contracts as ct
from ..operators import geometry as ge
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import pooling as po
from ..operators import similarity as si
from ..session import dealt
from ..sources import binary as bn
from .common import sql_stable, table

FIVE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
THREE = ["l_orderkey", "l_partkey", "l_suppkey"]


def five_key_join(spark, sf_dir):
    """Left one-to-one join on five columns; taxed lines have a partner, the others none."""
    lines = dealt(table(spark, sf_dir, "lineitem"), FIVE)
    left = lines.groupBy(*FIVE).agg(F.sum("l_quantity").alias("quantity"))
    right = lines.where(F.col("l_tax") > 0).groupBy(*FIVE).agg(F.sum("l_extendedprice").alias("price"))
    joined = ct.contract_join(left, right, FIVE, "one_to_one")
    return joined.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_partners"),
        stable(F.sum("quantity"), 2).alias("quantity"), stable(F.sum("price"), 2).alias("price"))


def three_key_join(spark, sf_dir):
    """Complete one-to-one join on three columns: every left key must have its partner."""
    lines = dealt(table(spark, sf_dir, "lineitem"), THREE)
    left = lines.groupBy(*THREE).agg(F.count(F.lit(1)).alias("n_lines"))
    right = lines.groupBy(*THREE).agg(F.max("l_discount").alias("discount"))
    joined = ct.contract_join(left, right, THREE, "one_to_one", complete=True)
    return joined.groupBy("l_suppkey").agg(
        F.sum("n_lines").alias("n_lines"), stable(F.avg("discount"), 6).alias("discount"))


UNIT = ["l_returnflag", "l_linestatus"]
SAMPLE = [*UNIT, "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber"]


def pooled_features(spark, sf_dir):
    """Samples and their features joined one to one, then pooled over scans (suppliers) to units."""
    lines = dealt(table(spark, sf_dir, "lineitem"), SAMPLE)
    samples = lines.select(*SAMPLE).distinct()
    features = lines.groupBy(*SAMPLE).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    pooled = po.pool_features(samples, features, SAMPLE, UNIT, "l_suppkey", SAMPLE)
    cells = [f"{f}__{part}" for f in ("quantity", "tax") for part in ("mean", "between_sd", "within_sd")]
    return pooled.select(*UNIT, "n_scans", *[stable(F.col(c), 5).alias(c) for c in cells])


CASE = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def registration_status(spark, sf_dir):
    """Transform per case: a manual one (dear orders) goes before an automatic one, else none."""
    orders = table(spark, sf_dir, "orders")

    def transforms(above: float):
        return orders.where(F.col("o_totalprice") > above).groupBy(*CASE).agg(F.max("o_orderkey").alias("transform_id"))

    sources = [(transforms(300000.0), "manual"), (transforms(150000.0), "automatic")]
    return jn.first_match(orders.select(*CASE).distinct(), sources, CASE, ["transform_id"])


def artefact_validation(spark, sf_dir):
    """A summary per customer from orders, re-validated against billed orders."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    stored = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lowest"))
    billed = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    fresh = billed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rules = {"positive": F.col("lowest") > 0, "at_most_twelve": F.col("n") <= 12}
    return ct.artefact_checks(stored, fresh, ["o_custkey"], ["n"], rules)


SEVEN = ["price", "part", "supplier", "line", "quantity", "discount", "tax"]


def seven_field_match(spark, sf_dir):
    """Lines matched within 1e-10 on seven fields; price and part choose the candidates."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_partkey").cast("double").alias("part"),
        F.col("l_suppkey").cast("double").alias("supplier"), F.col("l_linenumber").cast("double").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "l_orderkey")
    left = lines.withColumnRenamed("l_orderkey", "left_key")
    right = lines.withColumn("tax", F.col("tax") + 4e-11).withColumnRenamed("l_orderkey", "right_key")
    matched = jn.tolerance_join(left, right, [], SEVEN, "left_key", "right_key")
    return matched.groupBy("left_key").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("match_count").alias("matches"), F.min("right_key").alias("right_key"))


def correlation_gate(spark, sf_dir):
    """Vectors against their two-decimal copies: near-exact correlation of every pair."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", ar.as_doubles(F.col("embedding")).alias("a"))
    copies = e.select(F.col("vec_id"), F.transform("a", lambda x: F.floor(x * 100) / 100).alias("b"))
    pairs = ct.contract_join(e, copies, ["vec_id"], "one_to_one", complete=True)
    scored = pairs.select((ar.dot(ar.standardise(F.col("a")), ar.standardise(F.col("b"))) / F.size("a")).alias("r"))
    return si.correlation_gate(scored, "r").withColumn("weakest", stable(F.col("weakest"), 8))


def _pool_sql(feature: str) -> str:
    return f"""{sql_stable(f'avg({feature}_m)', 5)} AS {feature}__mean, {sql_stable(f'stddev_pop({feature}_m)', 5)} AS {feature}__between_sd,
        {sql_stable(f'avg({feature}_s)', 5)} AS {feature}__within_sd"""


def content_key_join(spark, sf_dir):
    """Documents with a manifest row each, found by id and content hash together: a row of another content is no partner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    content = F.sha2(F.col("text").cast("binary"), 256)
    manifest = docs.select("doc_id", content.alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))
    joined = ct.contract_join(docs.select("doc_id", "lang", content.alias("sha256")), manifest, ["doc_id", "sha256"], "one_to_one", complete=True)
    return joined.groupBy("lang").agg(F.count("bytes").alias("matched"), F.sum("bytes").alias("bytes"), F.min("sha256").alias("first_hash"))


def domain_gates(spark, sf_dir):
    """Row count and value domains proven before the counts are handed on."""
    lines = table(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n")).first()[0]
    ct.require_rows(lines, per_order, "lineitem")
    ct.require_domain(lines, "l_returnflag", ["A", "N", "R"], "lineitem")
    ct.require_domain(lines, "l_linestatus", ["F", "O"], "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def curve_semantics(spark, sf_dir):
    """Curve rules on the rasters' rows as curves: whole numbers, inside the image, in order, missing or negative."""
    e = table(spark, sf_dir, "embeddings")
    row = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.struct(c.alias("curve"), F.transform(
        F.slice("embedding", c * 8 + 1, 8), lambda x: F.when(x > -0.25, F.rint(x.cast("double") * 20 + c * 6) + F.when(x > 0.3, 0.5).otherwise(0.0))).alias("values")))
    curves = e.select(F.col("label").cast("string").alias("path"), F.col("vec_id").alias("scan"), F.explode(row).alias("r"))
    return bn.curve_checks(curves.select("path", "scan", "r.curve", F.col("r.values").alias("values")), 30)


CURVE_SQL = """WITH e AS (SELECT label, vec_id, unnest(range(0, 40)) AS k, unnest(embedding[1:40]) AS x FROM embeddings),
s AS (SELECT CAST(label AS VARCHAR) AS path, vec_id, CAST(k // 8 AS INT) AS curve, k % 8 AS col,
  CASE WHEN x > -0.25 THEN round_even(x::DOUBLE * 20 + k // 8 * 6, 0) + CASE WHEN x > 0.3 THEN 0.5 ELSE 0 END END AS v FROM e),
m AS (SELECT *, coalesce(v >= 0 AND v < 30, false) AS ok FROM s)
SELECT a.path, a.curve, count(*) AS n, count(*) FILTER (a.v IS NULL) AS missing, count(*) FILTER (a.v < 0) AS negative,
  count(*) FILTER (a.v >= 0 AND a.v <> round_even(a.v, 0)) AS non_integer, count(*) FILTER (a.v >= 30) AS outside,
  count(*) FILTER (a.ok AND b.ok AND b.v < a.v) AS order_violations
FROM m a LEFT JOIN m b ON a.vec_id = b.vec_id AND a.path = b.path AND b.curve = a.curve + 1 AND a.col = b.col GROUP BY 1, 2"""


def best_and_second(spark, sf_dir):
    """Every customer's dearest order and its margin over the next one."""
    return od.best_and_second(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice").select(
        "o_custkey", "o_orderkey", "best_score", stable(F.col("score_margin"), 3).alias("score_margin"))


def boxed_points(spark, sf_dir):
    """Points inside a closed box and inside half-open image bounds, by group."""
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    box = ge.inside_box(F.col("x"), F.col("y"), F.lit(10.0), F.lit(2.0), F.lit(30.0), F.lit(6.0))
    image = ge.inside_image(F.col("x"), F.col("y"), F.lit(30), F.lit(6))
    return p.groupBy("l_returnflag").agg(F.count_if(box).alias("in_box"), F.count_if(image).alias("in_image"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "content_key_join": (content_key_join, """WITH d AS (SELECT lang, sha256(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS b FROM documents)
        SELECT lang, count(*) AS matched, CAST(sum(b) AS BIGINT) AS bytes, min(h) AS first_hash FROM d GROUP BY 1"""),
    "domain_gates": (domain_gates, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "curve_semantics": (curve_semantics, CURVE_SQL),
    "best_and_second": (best_and_second, f"""WITH r AS (SELECT *, row_number() OVER w AS k, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
        SELECT o_custkey, o_orderkey, o_totalprice AS best_score, {sql_stable('o_totalprice - next', 3)} AS score_margin FROM r WHERE k = 1"""),
    "boxed_points": (boxed_points, """SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 10 AND 30 AND l_discount * 100 BETWEEN 2 AND 6) AS in_box,
        count(*) FILTER (l_quantity >= 0 AND l_quantity < 30 AND l_discount * 100 >= 0 AND l_discount * 100 < 6) AS in_image, count(*) AS n FROM lineitem GROUP BY 1"""),
    "five_key_join": (five_key_join, f"""
        WITH l AS (SELECT {', '.join(FIVE)}, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
        r AS (SELECT {', '.join(FIVE)}, sum(l_extendedprice) AS price FROM lineitem WHERE l_tax > 0 GROUP BY ALL)
        SELECT l_returnflag, count(*) AS n_rows, count(price) AS n_partners, {sql_stable('sum(quantity)', 2)} AS quantity,
          {sql_stable('sum(price)', 2)} AS price FROM l LEFT JOIN r USING ({', '.join(FIVE)}) GROUP BY 1"""),
    "three_key_join": (three_key_join, f"""
        WITH l AS (SELECT {', '.join(THREE)}, count(*) AS n, max(l_discount) AS d FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n_lines, {sql_stable('avg(d)', 6)} AS discount FROM l GROUP BY 1"""),
    "pooled_features": (pooled_features, f"""
        WITH f AS (SELECT {', '.join(SAMPLE)}, sum(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY ALL),
        s AS (SELECT {', '.join(UNIT)}, l_suppkey, avg(quantity) AS quantity_m, stddev_pop(quantity) AS quantity_s,
          avg(tax) AS tax_m, stddev_pop(tax) AS tax_s FROM f GROUP BY ALL)
        SELECT {', '.join(UNIT)}, count(*) AS n_scans, {_pool_sql('quantity')}, {_pool_sql('tax')} FROM s GROUP BY ALL"""),
    "registration_status": (registration_status, f"""
        SELECT {', '.join(CASE)}, coalesce(max(o_orderkey) FILTER (o_totalprice > 300000), max(o_orderkey) FILTER (o_totalprice > 150000)) AS transform_id,
          CASE WHEN max(o_totalprice) > 300000 THEN 'manual' WHEN max(o_totalprice) > 150000 THEN 'automatic' ELSE 'none' END AS matched_in
        FROM orders GROUP BY {', '.join(CASE)}"""),
    "artefact_validation": (artefact_validation, """
        WITH s AS (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lowest,
          count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS billed FROM orders GROUP BY 1)
        SELECT true AS unique_keys, bool_and(billed > 0) AS same_keys, bool_and(n = billed) AS same_measures,
          bool_and(lowest > 0) AS positive, bool_and(n <= 12) AS at_most_twelve FROM s"""),
    "seven_field_match": (seven_field_match, """
        WITH l AS (SELECT row_number() OVER () AS i, * FROM lineitem),
        m AS (SELECT a.i, count(b.i) AS hits, CASE WHEN count(b.i) = 1 THEN min(b.l_orderkey) END AS found
          FROM l a LEFT JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber
            AND abs(a.l_extendedprice - b.l_extendedprice) <= 1e-10 AND abs(a.l_quantity - b.l_quantity) <= 1e-10
            AND abs(a.l_discount - b.l_discount) <= 1e-10 AND abs(a.l_tax - (b.l_tax + 4e-11)) <= 1e-10 GROUP BY 1)
        SELECT l_orderkey AS left_key, count(*) AS n_lines, CAST(sum(hits) AS BIGINT) AS matches, min(found) AS right_key
        FROM l JOIN m USING (i) GROUP BY 1"""),
    "correlation_gate": (correlation_gate, f"""
        WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a FROM embeddings),
        r AS (SELECT vec_id, corr(a, floor(a * 100) / 100) AS r FROM e GROUP BY 1)
        SELECT count(*) AS pairs, {sql_stable('min(r)', 8)} AS weakest, count(*) FILTER (r < 0.99999) AS n_below,
          count(*) > 0 AND count(*) FILTER (r < 0.99999) = 0 AS passed FROM r"""),
}
