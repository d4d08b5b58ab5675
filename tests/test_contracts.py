import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestgrain.functions import numeric as nu, text as tx
from nestgrain.operators import cohort as co, contracts as ct, joins as jn, similarity as si


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_contract_join(spark):
    left = make(spark, [(1, "a"), (2, "b")], "k int, x string")
    right = make(spark, [(1, 10), (2, 20)], "k int, y int")
    twice = make(spark, [(1, 10), (1, 11)], "k int, y int")
    assert ct.contract_join(left, right, ["k"]).count() == 2
    with pytest.raises(ct.GateError):
        ct.contract_join(left, twice, ["k"], "many_to_one")
    with pytest.raises(ct.GateError):
        ct.contract_join(left.union(left), right, ["k"])
    assert ct.contract_join(left.union(left), right, ["k"], "many_to_one").count() == 4
    with pytest.raises(ct.GateError):
        ct.contract_join(left, right.limit(1), ["k"], complete=True)
    assert ct.contract_join(left, right.where("k = 1"), ["k"]).where("y is null").count() == 1


def test_gates(spark):
    df = make(spark, [(1, "a", 1), (1, "b", 2), (2, "a", 1)], "g int, m string, f int")
    with pytest.raises(ct.GateError, match="lacks"):
        ct.require_columns(df, ["zz"])
    with pytest.raises(ct.GateError):
        ct.require_label_blind(df.withColumnRenamed("f", "Sensitivity_db"))
    with pytest.raises(ct.GateError):
        ct.require_rows(df, 2)
    with pytest.raises(ct.GateError):
        ct.require_single_row(df)
    with pytest.raises(ct.GateError):
        ct.require_domain(df, "m", ["a"])
    with pytest.raises(ct.GateError):
        ct.require_domain(df, "m", ["a", "b", "c"])
    ct.require_domain(df, "m", ["a", "b"])
    with pytest.raises(ct.GateError, match="bad"):
        ct.require_checks({"good": True, "bad": False}, "stage")
    assert ct.require_checks(ct.check_row(df, {"ok": F.bool_and(F.col("f") > 0)}), "stage") == {"ok": True}
    assert ct.check_row(df.where("false"), {"all": F.bool_and(F.col("f") > 0), "any": F.bool_or(F.col("f") > 0)}).first() == (False, False)
    assert [r["g"] for r in ct.split_groups(df, "g", "f").collect()] == [1]
    assert [r["g"] for r in ct.wrong_member_set(df, ["g"], "f", [1, 2]).collect()] == [2]
    assert ct.numeric_features(df, ["g"]) == ["f"] and ct.prefixed(df, "m") == ["m"]
    with pytest.raises(ct.GateError):
        ct.stack([df, df.drop("f")])
    bad = make(spark, [(1.0,), (None,), (float("inf"),), (float("nan"),)], "x double")
    assert ct.non_finite_rows(bad, ["x"]).count() == 3


def test_overlay_and_sets(spark):
    base = make(spark, [(1, "p"), (2, "p")], "k int, d string")
    done = make(spark, [(1, "accept"), (2, "exclude")], "k int, d string")
    assert {tuple(r) for r in ct.overlay(base, done, ["k"], ["d"]).collect()} == {(1, "accept"), (2, "exclude")}
    with pytest.raises(ct.GateError):
        ct.overlay(base, done.limit(1), ["k"], ["d"])
    ledger = make(spark, [(1, "EXCLUDE"), (2, "keep")], "k int, decision string")
    assert [r["k"] for r in ct.exclude(base, ledger, "k").collect()] == [2]
    diff = ct.key_set_difference(base, make(spark, [(2,), (3,)], "k int"), ["k"])
    assert {tuple(r) for r in diff.collect()} == {(1, "left_only"), (3, "right_only")}
    empty = ct.reconcile(base, base, ["k"], ["d"])
    assert empty.isEmpty() and ct.reconcile(base, done, ["k"], ["d"]).count() == 2


def test_border_audit(spark):
    good = make(spark, [(0, 0, 3), (1, 3, 9)], "g int, start int, stop int")
    assert tuple(ct.border_audit(good, "g", "start", "stop").first()) == (2, True, True, True, 9)
    gap = make(spark, [(0, 1, 3), (1, 4, 4)], "g int, start int, stop int")
    row = ct.border_audit(gap, "g", "start", "stop").first()
    assert not row["starts_at_zero"] and not row["strictly_positive_spans"] and not row["contiguous"]


def test_tolerance_edges(spark):
    left = make(spark, [(1, "R", 1.0), (2, "R", 2.0), (3, "L", 1.0), (4, "R", 5.0)], "lid int, eye string, a double")
    right = make(spark, [(11, "R", 1.0 + 9e-11), (12, "R", 2.0), (13, "R", 2.0 - 5e-11), (14, "R", 5.0 + 2e-10)], "rid int, eye string, a double")
    got = {r["lid"]: (r["match_count"], r["rid"]) for r in jn.tolerance_join(left, right, ["eye"], ["a"], "lid", "rid").collect()}
    assert got == {1: (1, 11), 2: (2, None), 3: (0, None), 4: (0, None)}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        nu.half_even(F.lit(2.5)).alias("a"), nu.half_even(F.lit(0.125), 2).alias("b"), nu.guarded_ceil(F.lit(3.0 + 1e-13)).alias("c"),
        nu.clip(F.lit(9.0), -1.0, 5.0).alias("d"), nu.ratio(F.lit(1.0), F.lit(0.0)).alias("e"), nu.whole_number(F.lit("12.7")).alias("f"),
        nu.number_or_zero(F.lit("")).alias("g"), nu.parse_flag(F.lit(" Yes ")).alias("h"), nu.parse_flag(F.lit(True)).alias("i"),
        tx.normalise_source_name(F.lit("x/7_od.png")).alias("j"), tx.normalise_source_name(F.lit("a_b.png")).alias("k"),
        tx.trailing_index(F.lit("v/volume_012.png")).alias("l"), tx.padded(F.lit(7)).alias("m"), tx.mapped(F.lit("q"), {"z": 1}).alias("n"),
    ).first()
    assert tuple(row) == (2.0, 0.12, 3, 5.0, None, 12, 0.0, True, True, "007_OD.PNG", "A_B.PNG", 12, "007", None)


def test_freeze_review_and_sources(spark):
    audits = make(spark, [("a", "completed", "s"), ("b", "completed", "s"), ("c", "failed", "t"), ("d", "completed", "t")], "case_id string, processing_status string, stratum string")
    decisions = make(spark, [("a", "accept"), ("b", "exclude")], "case_id string, decision string")
    ok, ledger = co.freeze_cohort(audits, decisions, "case_id", "accept", "exclude")
    assert sorted(r[0] for r in ok.collect()) == ["a", "d"] and [r["case_id"] for r in ledger.collect()] == ["b"]
    with pytest.raises(ct.GateError):
        co.freeze_cohort(audits, decisions.union(make(spark, [("d", "pending")], "a string, b string")), "case_id", "accept", "exclude")
    found = co.exceptions(audits, ["case_id"], [(F.col("case_id") == "a", "far", "high", F.lit(3), "<2"), (F.col("stratum") == "s", "edge", "medium", F.lit(1), "0")])
    queue = {r["case_id"]: (r["review_reason"], r["issues"]) for r in co.review_queue(audits, found, "case_id", ["stratum"]).collect()}
    assert queue == {"a": ("flagged", "edge|far"), "b": ("flagged", "edge"), "d": ("unflagged_sample", "")}
    listing = make(spark, [("x/a.png",)], "path string")
    audit = co.source_audit(audits.limit(2), "case_id", {"img": F.concat(F.lit("x/"), F.col("case_id"), F.lit(".png"))}, listing)
    assert audit.where("exists").count() == 1 and audit.count() == 2


def test_residual_and_signatures(spark):
    labels = make(spark, [("c", 1), ("c", 1), ("c", 5), ("e", 2), ("e", 3)], "case string, v int")
    ring = make(spark, [("c", 1), ("c", 5), ("e", 2), ("e", 9)], "case string, v int")
    got = {r["case"]: (r["centre_value"], r["recovered"]) for r in co.residual_value(ring, labels, "case", "v").collect()}
    assert got == {"c": (1, True), "e": (None, False)}
    rows = [(p, c, v) for p, values in {1: (0, 5), 2: (0, 5), 3: (5, 0), 4: (0, 6)}.items() for c, v in enumerate(values)]
    out = co.signature_groups(make(spark, rows, "point int, case int, v int"), "point", "case", "v").toPandas().set_index("point")
    assert out.representative.to_dict() == {1: 1, 2: 1, 3: 3, 4: 4} and out.group_size.to_dict() == {1: 2, 2: 2, 3: 1, 4: 1}


def test_common_indices(spark):
    a = make(spark, [("k", i) for i in (1, 2, 5, 7, 9)], "k string, i int")
    b = make(spark, [("k", i) for i in (2, 5, 7, 8)], "k string, i int")
    assert tuple(jn.common_indices(a, b, ["k"], "i").first()) == ("k", 3, 2, 5, 7)


def test_enumerate_never_counts_down(spark):
    df = make(spark, [(1, 3), (5, 4)], "a int, b int")
    assert [r["n"] for r in jn.enumerate_range(df, "a", "b", "n").collect()] == [1, 2, 3]


def test_artefact_checks(spark):
    source = spark.createDataFrame([("a", 2), ("b", None)], "k string, n int")
    rules = {"small": F.coalesce(F.col("n"), F.lit(0)) < 5}

    def found(rows):
        table = spark.createDataFrame(rows, "k string, n int")
        return ct.artefact_checks(table, source, ["k"], ["n"], rules).first().asDict()

    good = {"unique_keys": True, "same_keys": True, "same_measures": True, "small": True}
    assert found([("a", 2), ("b", None)]) == good
    assert found([("a", 2), ("a", 2), ("b", None)]) == good | {"unique_keys": False}
    assert found([("a", 9), ("b", None)]) == good | {"same_measures": False, "small": False}
    assert not found([("a", 2)])["same_keys"]
    assert not found([("a", 2), ("b", None), ("c", 1)])["same_keys"]
    assert not any(found([])[name] for name in ("unique_keys", "same_keys", "small"))


def test_correlation_gate(spark):
    def found(values):
        return si.correlation_gate(spark.createDataFrame([(v,) for v in values], "r double"), "r").first()

    assert tuple(found([1.0, 0.99999])) == (2, 0.99999, 0, True)
    assert tuple(found([1.0, 0.5, None, float("nan")])) == (4, 0.5, 3, False)
    assert tuple(found([])) == (0, None, 0, False)


def test_tolerance_join_bands(spark):
    fields = [f"f{i}" for i in range(7)]
    schema = "id long, " + ", ".join(f"{f} double" for f in fields)
    rows = [(i, *[float((i * (j + 3)) % 11) for j in range(7)]) for i in range(40)]
    moved = [(i + 100, *[v + 5e-11 for v in values]) for i, *values in rows]
    far = [(i + 200, *values[:6], values[6] + 1e-6) for i, *values in rows]
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame(moved + far, schema).withColumnRenamed("id", "other")
    got = [jn.tolerance_join(left, right, [], fields, "id", "other", bands=b).toPandas().set_index("id")["match_count"].to_dict() for b in (1, 2, 7)]
    want = {i: sum(values == other for _, *other in rows) for i, *values in rows}
    assert got == [want] * 3


def test_keep_mapped_parts_follow_the_rows(spark):
    """Sides too large to broadcast meet in as many parts as their rows need, not in the session's fixed number of them."""
    rows = spark.range(4000).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("n"))
    mapping = spark.range(3000).select((F.col("id") % 600).alias("k"), (F.col("id") % 600).alias("n"))
    spark.conf.set("nestgrain.rowsPerPart", "100")
    spark.conf.set("nestgrain.broadcastRows", "10")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, missing = ct.keep_mapped(rows, mapping, ["k", "n"])
        want = [r for r in rows.collect() if r["n"] is not None and r["k"] < 600]
        assert sorted(kept.collect()) == sorted(want)
        alone = {(r["k"], r["n"]) for r in rows.collect()} - {(r["k"], r["n"]) for r in want}
        assert len(missing.collect()) == len(alone) and {tuple(r) for r in missing.collect()} == alone
        assert kept.rdd.getNumPartitions() == missing.rdd.getNumPartitions() == 70
    finally:
        for name in ("nestgrain.rowsPerPart", "nestgrain.broadcastRows", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_dealt_sides_meet_in_parts_that_follow_the_rows(spark):
    """Grouped and joined in the parts they were dealt to: no shuffle into the session's fixed number of parts."""
    from nestgrain.session import dealt
    spark.conf.set("nestgrain.rowsPerPart", "50")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = dealt(spark.range(1000).select((F.col("id") % 500).alias("a"), (F.col("id") % 250).alias("b")), ["a", "b"])
        left = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        joined = ct.contract_join(left, rows.where("b > 9").groupBy("a", "b").agg(F.max("a").alias("m")), ["a", "b"])
        assert joined.rdd.getNumPartitions() == 20 and joined.count() == 500 and joined.where("m IS NULL").count() == 20
        assert ct.key_proof(left, rows.where("b > 9"), ["a", "b"]) == {"left_most": 1, "right_most": 2, "left_alone": 20, "right_alone": 0}
    finally:
        spark.conf.unset("nestgrain.rowsPerPart")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    gaps = spark.createDataFrame([(1,), (None,)], "k int")
    assert ct.key_proof(gaps, gaps, ["k"]) == {"left_most": 1, "right_most": 1, "left_alone": 1, "right_alone": 1}
