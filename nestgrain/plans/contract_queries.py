"""Registered queries: gates, key-contract joins, set operations, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import number_or_zero, parse_flag, stable
from ..operators import contracts as ct
from ..operators import folds as fo
from ..operators import joins as jn
from ..operators import ordered as od
from .common import sql_stable, table


def key_uniqueness(spark, sf_dir):
    return ct.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def wrong_cardinality(spark, sf_dir):
    return ct.wrong_cardinality(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4)


def wrong_member_set(spark, sf_dir):
    return ct.wrong_member_set(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2, 3])


def fold_isolation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("fold", (F.col("o_orderkey") % 5 + 1).cast("int"))
    return ct.split_groups(orders, "o_custkey", "fold")


def orphan_keys(spark, sf_dir):
    return ct.orphans(table(spark, sf_dir, "events").select(F.col("user_id").alias("k")),
                      table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


def key_set_difference(spark, sf_dir):
    return ct.key_set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def multiset_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low, high = e.where(F.col("user_id") < 100), e.where(F.col("user_id") >= 100)
    return ct.multiset_difference(low, high, ["event_type", "value"])


def reconcile_summary(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    declared = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    billed = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey").agg(
        F.countDistinct("o_orderkey").alias("n"))
    return ct.reconcile(declared, billed, ["o_custkey"], ["n"])


def label_consistency(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_linestatus") != F.col("o_orderstatus")).alias("n_mismatch"))


def null_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ct.null_counts(docs, ["doc_id", "lang", "quality", "toxic"])


def one_to_one_join(spark, sf_dir):
    docs = ct.require_label_blind(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"))
    joined = ct.contract_join(docs, table(spark, sf_dir, "labels"), ["doc_id"], "one_to_one")
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("quality").alias("n_labelled"),
        F.sum(F.col("quality").cast("bigint")).alias("n_good"))


def many_to_one_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    joined = ct.contract_join(table(spark, sf_dir, "customer"), nations, ["c_nationkey"], "many_to_one", complete=True)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), stable(F.sum("c_acctbal"), 2).alias("balance"))


def chained_lookup(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    step = ct.contract_join(customer, nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], "many_to_one")
    step = ct.contract_join(step, region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], "many_to_one")
    return step.select("c_custkey", "r_name", (F.col("n_regionkey") * 1000 + F.col("c_nationkey")).cast("bigint").alias("position"))


def decision_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"))
    decided = base.join(used, "p_partkey", "left").select(
        "p_partkey", F.when(F.coalesce(F.col("uses"), F.lit(0)) >= 30, "keep").otherwise("review").alias("p_brand"))
    return ct.overlay(base, decided, ["p_partkey"], ["p_brand"])


def anti_exclusion(spark, sf_dir):
    ledger = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_nationkey") == 3, "Exclude").otherwise("keep").alias("decision"))
    kept = ct.exclude(table(spark, sf_dir, "orders"), ledger, "o_custkey")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), stable(F.sum("o_totalprice"), 2).alias("total"))


def mapped_and_unmapped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    kept, missing = ct.keep_mapped(orders, lines, ["k"])
    return kept.select("k", F.lit("mapped").alias("state")).unionByName(missing.select("k", F.lit("unmapped").alias("state")))


def first_match(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("label"))
    customers = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("label"))
    return jn.first_match(users, [(suppliers, "supplier"), (customers, "customer")], ["user_id"], ["label"])


def patched_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    overrides = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return jn.patch_rows(nations, overrides, ["n_nationkey"], ["n_name"])


def tolerance_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    right = part.select(F.col("p_partkey").alias("right_key"), "p_brand", (F.col("p_retailprice") + 4e-11).alias("price"), F.col("p_size").cast("double").alias("size"))
    left = part.select(F.col("p_partkey").alias("left_key"), "p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    hits = jn.tolerance_join(left, right, ["p_brand"], ["price", "size"], "left_key", "right_key")
    return hits.select("left_key", "match_count", "right_key")


def range_join(spark, sf_dir):
    borders = _borders(spark, sf_dir)
    at = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 10).cast("bigint").alias("pos"))
    joined = jn.range_join(at, borders, [], "pos", "start", "stop")
    return joined.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


def _borders(spark, sf_dir):
    """Half-open borders per supplier: cumulative order of their sizes."""
    sizes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("grp"), (F.floor(F.abs("s_acctbal")) % 300 + 1).cast("bigint").alias("span"))
    ends = od.running_sum(sizes, [], ["grp"], "span", "stop")
    return ends.select("grp", (F.col("stop") - F.col("span")).alias("start"), "stop")


_BORDERS_SQL = """borders AS (SELECT grp, stop - span AS start, stop FROM (SELECT grp, span, CAST(sum(span) OVER (ORDER BY grp) AS BIGINT) AS stop
  FROM (SELECT s_suppkey AS grp, CAST(floor(abs(s_acctbal)) AS BIGINT) % 300 + 1 AS span FROM supplier)))"""


def border_audit(spark, sf_dir):
    return ct.border_audit(_borders(spark, sf_dir), "grp", "start", "stop")


def border_span_counts(spark, sf_dir):
    return _borders(spark, sf_dir).groupBy((F.col("stop") - F.col("start")).alias("span")).agg(F.count(F.lit(1)).alias("n"))


def enumerated_ranges(spark, sf_dir):
    rows = jn.enumerate_range(_borders(spark, sf_dir).withColumn("last", F.col("stop") - 1), "start", "last", "pos")
    return rows.select("grp", "pos")


def common_indices(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor("value").cast("bigint").alias("idx"), "event_type")
    return jn.common_indices(e.where(F.col("event_type") == "click"), e.where(F.col("event_type") != "click"), ["user_id"], "idx")


def normalised_names(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("", F.lit("in/"), (F.col("p_partkey") % 50).cast("string"), F.lit("_"), F.lower("p_type")).alias("name"))
    named = raw.select(tx.normalise_source_name(F.col("name")).alias("normalised"))
    return named.groupBy("normalised").agg(F.count(F.lit(1)).alias("n"))


def parsed_flags(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, " TRUE ").when(F.col("l_linenumber") == 2, "yes").when(F.col("l_linenumber") == 3, "1")
        .when(F.col("l_linenumber") == 4, "False").otherwise("").alias("raw"))
    return raw.groupBy("raw").agg(F.count_if(parse_flag(F.col("raw"))).alias("n_true"), F.count(F.lit(1)).alias("n"))


def column_totals(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_quantity").cast("string")).alias("a"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("b"))
    return raw.groupBy("l_returnflag").agg(
        stable(F.sum(number_or_zero(F.col("a"))), 2).alias("total_a"), stable(F.sum(number_or_zero(F.col("b"))), 2).alias("total_b"))


def checkpoint_key_audit(spark, sf_dir):
    """Expected against present keys with an allow-list and allowed prefixes."""
    expected = table(spark, sf_dir, "part").select(F.col("p_name").alias("k")).distinct()
    found = table(spark, sf_dir, "part").where(F.col("p_size") > 25).select(F.concat_ws(" ", F.col("p_name"), F.col("p_type")).alias("k")).unionByName(
        table(spark, sf_dir, "part").where(F.col("p_size") <= 25).select(F.col("p_name").alias("k"))).distinct()
    diff = ct.key_set_difference(expected, found, ["k"])
    return diff.where(~F.col("k").startswith("small ") & ~F.col("k").isin("red widget", "blue ring"))


def gate_row(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ct.check_row(o, {
        "positive_totals": F.bool_and(F.col("o_totalprice") > 0),
        "known_status": F.bool_and(F.col("o_orderstatus").isin("O", "F", "P")),
        "any_urgent": F.bool_or(F.col("o_orderpriority") == "1-URGENT"),
        "unique_key": F.count(F.lit(1)) == F.countDistinct("o_orderkey"),
    })


def frequency_table(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("final"),
        F.sum((F.col("o_totalprice") > 200000).cast("bigint")).alias("large"))


def stacked_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = ct.stack([o.where(F.col("o_orderstatus") == s).withColumn("block", F.lit(s)) for s in ("F", "O", "P")])
    return both.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


# ---- folds ---------------------------------------------------------------------

def _participants(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("participant")).agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(F.col("o_orderstatus") == "F").alias("baseline"),
        F.count_if(F.col("o_orderstatus") == "O").alias("year_one"))


def greedy_folds(spark, sf_dir):
    return fo.balanced_folds(_participants(spark, sf_dir), "participant", ["visits", "baseline", "year_one"], 5)


def fold_summary(spark, sf_dir):
    assigned = greedy_folds(spark, sf_dir)
    return fo.fold_summary(assigned, "fold", ["visits", "baseline", "year_one"])


def group_kfold(spark, sf_dir):
    return fo.group_kfold(table(spark, sf_dir, "orders"), "o_custkey", 4)


def _greedy_sql(participants: str, loads: list[str], n: int, with_count: bool, final: str) -> str:
    """Sequential placement as a recursive CTE over the ordered participants."""
    order = ", ".join(f"{x} DESC" for x in loads)
    fields = ["f", *loads, "cnt"]
    init = ", ".join("{" + ", ".join([f"'f': {k}"] + [f"'{x}': 0::BIGINT" for x in [*loads, "cnt"]]) + "}" for k in range(1, n + 1))
    rank = [loads[0], *(["cnt"] if with_count else []), *loads[1:], "f"]
    best = ("list_sort(list_transform(st, lambda s: {" + ", ".join(f"'k{i}': s.{x}" for i, x in enumerate(rank)) + "}))[1].k"
            + str(len(rank) - 1))
    step = "{" + ", ".join(
        ["'f': s.f"] + [f"'{x}': s.{x} + CASE WHEN s.f = b.best THEN {'b.' + x if x != 'cnt' else '1'} ELSE 0 END" for x in fields[1:]]
    ) + "}"
    # two steps per row: choose, then update
    columns = ", ".join(f"q.{x}" for x in loads)
    return f"""WITH RECURSIVE parts AS ({participants}),
seq AS (SELECT *, row_number() OVER (ORDER BY {order}, participant) AS i FROM parts),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS participant, 0 AS fold, [{init}] AS st
  UNION ALL
  SELECT b.i, b.participant, b.best, list_transform(b.st, lambda s: {step})
  FROM (SELECT q.i, q.participant, {columns}, w.st, (({best})) AS best FROM walk w JOIN seq q ON q.i = w.i + 1) b
)
{final}"""


_PARTS_SQL = """SELECT o_custkey AS participant, count(*) AS visits, count(*) FILTER (o_orderstatus = 'F') AS baseline,
 count(*) FILTER (o_orderstatus = 'O') AS year_one FROM orders GROUP BY 1"""
_LOADS = ["visits", "baseline", "year_one"]
GREEDY_SQL = _greedy_sql(_PARTS_SQL, _LOADS, 5, True,
    "SELECT participant, visits, baseline, year_one, CAST(fold AS INT) AS fold FROM walk JOIN parts USING (participant)")
FOLD_SUMMARY_SQL = _greedy_sql(_PARTS_SQL, _LOADS, 5, True, """SELECT CAST(fold AS INT) AS fold, count(*) AS groups, CAST(sum(visits) AS BIGINT) AS visits,
 CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(year_one) AS BIGINT) AS year_one FROM walk JOIN parts USING (participant) GROUP BY 1""")
KFOLD_SQL = _greedy_sql("SELECT o_custkey AS participant, count(*) AS n_rows FROM orders GROUP BY 1", ["n_rows"], 4, False,
    "SELECT participant AS o_custkey, CAST(fold AS INT) AS fold FROM walk WHERE i > 0")


def null_model(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_suppkey") % 5 + 1).cast("int"))
    means = fo.leave_fold_out_mean(lines, "fold", "l_extendedprice")
    scored = lines.join(F.broadcast(means), "fold")  # one row per fold
    return scored.groupBy("fold").agg(
        stable(F.max("training_mean"), 4).alias("training_mean"),
        stable(F.avg(F.abs(F.col("training_mean") - F.col("l_extendedprice"))), 4).alias("mae"),
        F.count(F.lit(1)).alias("n"))


QUERIES = {
    "key_uniqueness": (key_uniqueness, "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "wrong_cardinality": (wrong_cardinality, "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) <> 4"),
    "wrong_member_set": (wrong_member_set, """SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1
        HAVING list_sort(list(l_linenumber)) <> [1, 2, 3]"""),
    "fold_isolation": (fold_isolation, """SELECT o_custkey, min(f) AS first_fold, max(f) AS last_fold
        FROM (SELECT o_custkey, CAST(o_orderkey % 5 + 1 AS INT) AS f FROM orders) GROUP BY 1 HAVING count(DISTINCT f) > 1"""),
    "orphan_keys": (orphan_keys, "SELECT DISTINCT user_id AS k FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)"),
    "key_set_difference": (key_set_difference, """
        (SELECT doc_id, 'left_only' AS side FROM documents EXCEPT SELECT doc_id, 'left_only' FROM labels)
        UNION ALL (SELECT doc_id, 'right_only' FROM labels EXCEPT SELECT doc_id, 'right_only' FROM documents)"""),
    "multiset_difference": (multiset_difference, """
        SELECT event_type, value, n AS surplus FROM (
          SELECT event_type, value, CAST(sum(CASE WHEN user_id < 100 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM events GROUP BY 1, 2) WHERE n <> 0"""),
    "reconcile_summary": (reconcile_summary, """
        WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
        a AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT o_custkey, d.n AS declared_n, a.n AS actual_n FROM d FULL JOIN a USING (o_custkey) WHERE d.n IS DISTINCT FROM a.n"""),
    "label_consistency": (label_consistency, """SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (l_linestatus <> o_orderstatus) AS n_mismatch
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""),
    "null_counts": (null_counts, """WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
        SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS null_rows FROM j
        UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM j UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j
        UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j"""),
    "one_to_one_join": (one_to_one_join, """SELECT lang, count(*) AS n_rows, count(quality) AS n_labelled, CAST(sum(quality) AS BIGINT) AS n_good
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""),
    "many_to_one_join": (many_to_one_join, f"""SELECT n_name, count(*) AS n, {sql_stable('sum(c_acctbal)', 2)} AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""),
    "chained_lookup": (chained_lookup, """SELECT c_custkey, r_name, CAST(n_regionkey * 1000 + c_nationkey AS BIGINT) AS position
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "decision_overlay": (decision_overlay, """SELECT p_partkey, p_size, CASE WHEN coalesce(uses, 0) >= 30 THEN 'keep' ELSE 'review' END AS p_brand
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""),
    "anti_exclusion": (anti_exclusion, f"""SELECT o_orderstatus, count(*) AS n, {sql_stable('sum(o_totalprice)', 2)} AS total
        FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1"""),
    "mapped_and_unmapped": (mapped_and_unmapped, """SELECT o_orderkey AS k,
        CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'mapped' ELSE 'unmapped' END AS state FROM orders"""),
    "first_match": (first_match, """SELECT user_id, n, coalesce(s_name, c_name) AS label,
        CASE WHEN s_name IS NOT NULL THEN 'supplier' WHEN c_name IS NOT NULL THEN 'customer' ELSE 'none' END AS matched_in
        FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) LEFT JOIN supplier ON s_suppkey = user_id
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id"""),
    "patched_rows": (patched_rows, """SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey
        FROM nation LEFT JOIN region ON r_regionkey = n_nationkey"""),
    "tolerance_join": (tolerance_join, """
        SELECT a.p_partkey AS left_key, count(b.p_partkey) AS match_count, CASE WHEN count(b.p_partkey) = 1 THEN min(b.p_partkey) END AS right_key
        FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - (b.p_retailprice + 4e-11)) <= 1e-10
          AND abs(a.p_size::DOUBLE - b.p_size::DOUBLE) <= 1e-10 GROUP BY 1"""),
    "range_join": (range_join, f"""WITH {_BORDERS_SQL}
        SELECT grp, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos
        FROM (SELECT CAST(floor(l_extendedprice / 10) AS BIGINT) AS pos FROM lineitem) JOIN borders ON pos >= start AND pos < stop GROUP BY 1"""),
    "border_audit": (border_audit, f"""WITH {_BORDERS_SQL}, n AS (SELECT *, lead(start) OVER (ORDER BY grp) AS nxt FROM borders)
        SELECT count(*) AS volume_count, arg_min(start, grp) = 0 AS starts_at_zero, bool_and(stop > start) AS strictly_positive_spans,
        bool_and(coalesce(nxt = stop, true)) AS contiguous, arg_max(stop, grp) AS final_exclusive FROM n"""),
    "border_span_counts": (border_span_counts, f"WITH {_BORDERS_SQL} SELECT stop - start AS span, count(*) AS n FROM borders GROUP BY 1"),
    "enumerated_ranges": (enumerated_ranges, f"WITH {_BORDERS_SQL} SELECT grp, unnest(range(start, stop)) AS pos FROM borders"),
    "common_indices": (common_indices, """
        WITH e AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS idx, event_type = 'click' AS c FROM events),
        b AS (SELECT user_id, list_sort(list(idx)) AS l FROM (SELECT user_id, idx FROM e GROUP BY 1, 2 HAVING count(DISTINCT c) = 2) GROUP BY 1)
        SELECT user_id, len(l) AS n_common, l[1] AS first_index, l[len(l) // 2 + 1] AS middle_index, l[len(l)] AS last_index FROM b"""),
    "normalised_names": (normalised_names, """SELECT upper(lpad(CAST(p_partkey % 50 AS VARCHAR), 3, '0') || '_' || p_type) AS normalised, count(*) AS n
        FROM part GROUP BY 1"""),
    "parsed_flags": (parsed_flags, """
        SELECT raw, count(*) FILTER (lower(trim(raw)) IN ('true', '1', 'yes')) AS n_true, count(*) AS n FROM (
          SELECT CASE l_linenumber WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'yes' WHEN 3 THEN '1' WHEN 4 THEN 'False' ELSE '' END AS raw FROM lineitem) GROUP BY 1"""),
    "column_totals": (column_totals, f"""SELECT l_returnflag, {sql_stable('sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END)', 2)} AS total_a,
        {sql_stable('sum(CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_linenumber END)', 2)} AS total_b FROM lineitem GROUP BY 1"""),
    "checkpoint_key_audit": (checkpoint_key_audit, """
        WITH x AS (SELECT DISTINCT p_name AS k FROM part),
        f AS (SELECT DISTINCT CASE WHEN p_size > 25 THEN p_name || ' ' || p_type ELSE p_name END AS k FROM part)
        SELECT * FROM ((SELECT k, 'left_only' AS side FROM x WHERE k NOT IN (SELECT k FROM f)) UNION ALL
          (SELECT k, 'right_only' FROM f WHERE k NOT IN (SELECT k FROM x)))
        WHERE k NOT LIKE 'small %' AND k NOT IN ('red widget', 'blue ring')"""),
    "gate_row": (gate_row, """SELECT bool_and(o_totalprice > 0) AS positive_totals, bool_and(o_orderstatus IN ('O', 'F', 'P')) AS known_status,
        bool_or(o_orderpriority = '1-URGENT') AS any_urgent, count(*) = count(DISTINCT o_orderkey) AS unique_key FROM orders"""),
    "frequency_table": (frequency_table, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"),
    "distinct_counts": (distinct_counts, """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS final,
        count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1"""),
    "stacked_blocks": (stacked_blocks, """SELECT o_orderstatus AS block, count(*) AS n, count(DISTINCT o_orderkey) AS keys
        FROM orders GROUP BY 1"""),
    "greedy_folds": (greedy_folds, GREEDY_SQL),
    "fold_summary": (fold_summary, FOLD_SUMMARY_SQL),
    "group_kfold": (group_kfold, KFOLD_SQL),
    "null_model": (null_model, f"""
        WITH l AS (SELECT CAST(l_suppkey % 5 + 1 AS INT) AS fold, l_extendedprice AS y FROM lineitem),
        k AS (SELECT fold, sum(y) AS s, count(y) AS n FROM l GROUP BY 1),
        m AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS t FROM k)
        SELECT fold, {sql_stable('max(t)')} AS training_mean, {sql_stable('avg(abs(t - y))')} AS mae, count(*) AS n FROM l JOIN m USING (fold) GROUP BY 1"""),
}
