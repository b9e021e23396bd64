"""Transformation against brute force on small hand-written tables, and its plan."""

import itertools

from pyspark.sql import functions as F

from siteshift.layouts import MARC_TARGET, MBEW_TARGET, READ, REQUIRED, ROUTES
from siteshift.operators.explain import pair_with_source
from siteshift.plans.transform import build_expected, keyed_targets, transform_table
from siteshift.session import tune


def table(spark, name, rows):
    columns = [*REQUIRED[name], "_row_id"]
    data = [tuple(str(i).zfill(6) if c == "_row_id" else r.get(c) for c in columns) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns))


def small_tables(spark):
    marc = [dict(MATNR=m, WERKS=w, BESKZ=b, SOBSL=o, SFCPF=f, LOSGR="2.5", BSTMI="3", LGPRO="P1")
            for m, (w, b), (o, f) in itertools.product(
                ["1", "2", "3", None], [("1021", "F"), ("1021", "G"), ("1025", "E"), ("1055", "F")],
                [(None, None), ("40", "DAP3")])]
    mara = [dict(MATNR="1", MTART="FERT", MEINS="CS"), dict(MATNR="1", MTART="ROH", MEINS="EA"), dict(MATNR="2", MTART="NVAL"),
            dict(MATNR=None, MTART="HALB", MEINS="CS"), dict(MATNR="3", MTART=None), dict(MATNR="3", MTART="FERT", LVORM="X")]
    marm = [dict(MATNR="1", MEINH="EA", UMREN="4"), dict(MATNR="1", MEINH="EA", UMREN="9"), dict(MATNR=None, MEINH="EA", UMREN="2")]
    ekgrp = [dict(MATNR="1", WERKS="1021", EKGRP="A"), dict(MATNR="1", WERKS="1021", EKGRP="B"),
             dict(MATNR="1", WERKS="1021", EKGRP="A")]
    rows = {"MARC": marc, "MARA": mara, "MARM": marm, "EKGRP": ekgrp}
    return rows, {n: table(spark, n, r) for n, r in rows.items()}


def brute_force(rows):
    """(product, plant, LOSGR, EKGRP) of every expected row, by nested loops."""
    def eligible(m):
        return any(a["MATNR"] == m and not a.get("LVORM") and a["MTART"] not in (None, "NVAL") for a in rows["MARA"])

    base = set()
    for r in rows["MARC"]:
        if r["WERKS"] == "1021" and eligible(r["MATNR"]):
            if r["SFCPF"] == "DAP3" or (r["BESKZ"] == "F" and r["SOBSL"]):
                base.add((r["MATNR"], "US30"))
            elif r["BESKZ"] == "F":
                base |= {(r["MATNR"], "US30"), (r["MATNR"], "US27")}
    out = set()
    for r in rows["MARC"]:
        plants = {"1025": ["US29"], "1021": [p for m, p in base if m == r["MATNR"]]}.get(r["WERKS"], [])
        context = [a for a in rows["MARA"] if a["MATNR"] == r["MATNR"]] or [{}]
        unit = next((m["UMREN"] for m in rows["MARM"] if m["MATNR"] == r["MATNR"]), None)
        groups = [g["EKGRP"] for g in rows["EKGRP"] if (g["MATNR"], g["WERKS"]) == (r["MATNR"], r["WERKS"])] or [""]
        for p, a, g in itertools.product(plants, context, groups):
            if a.get("MTART") == "NVAL" or a.get("LVORM"):
                continue
            scaled = a.get("MTART") == "FERT" and a.get("MEINS") == "CS"
            lot = f"{2.5 * float(unit):g}" if scaled and unit else None if scaled else "2.5"
            out.add((r["MATNR"], p, lot, g))
    return out


def test_repeated_keys_and_null_keys_match_brute_force(spark):
    rows, tables = small_tables(spark)
    got = {tuple(r) for r in transform_table("MARC", tables).select("PRODUCT", "WERKS", "LOSGR", "EKGRP").collect()}
    assert got == brute_force(rows)
    assert any(product is None for product, *_ in got)


def test_output_is_a_set_in_target_layout(spark):
    _, tables = small_tables(spark)
    out = transform_table("MARC", tables)
    assert out.columns == MARC_TARGET and len(MARC_TARGET) == 146 and len(MBEW_TARGET) == 41
    assert out.count() == out.distinct().count()
    assert out.filter("WERKS IN ('1021', '1028', '1030', '1025', '1000', '1029')").count() == 0


def test_copies_of_one_key_change_nothing(spark):
    """A key with most of the rows goes through the repeated branch and leaves one copy."""
    _, tables = small_tables(spark)
    hot = tables["MARC"].filter("MATNR = '1' AND WERKS = '1021'")
    copies = hot.crossJoin(spark.range(500).select()).select(*hot.columns)
    skewed = {**tables, "MARC": tables["MARC"].unionByName(copies)}
    once, many = transform_table("MARC", tables), transform_table("MARC", skewed)
    assert sorted(map(str, once.collect())) == sorted(map(str, many.collect()))


def test_optional_and_missing_references(spark):
    _, tables = small_tables(spark)
    out = transform_table("MARC", {**tables, "EKGRP": None})
    assert {r[0] for r in out.select("EKGRP").distinct().collect()} == {""}
    try:
        build_expected("MBEW", {"MBEW": tables["MARC"], "MARA": tables["MARA"]})
        raise AssertionError("missing tables accepted")
    except ValueError as e:
        assert "MARM" in str(e) and "MARC" in str(e)


def final_plan(df):
    """Physical plan after adaptive execution has run it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_plan_has_no_python_and_no_cross_join(spark):
    _, tables = small_tables(spark)
    plan = final_plan(transform_table("MARC", tables))
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "HashJoin" in plan and "SortMergeJoin" not in plan


def test_distinct_takes_the_partitions_of_the_join(spark):
    _, tables = small_tables(spark)
    plan = final_plan(transform_table("MARC", tables))
    assert "hashpartitioning(PRODUCT" not in plan and plan.count("hashpartitioning(_key") > 0


def test_fields_the_extract_lacks_are_null(spark):
    _, tables = small_tables(spark)
    lean = {**tables, "MARC": tables["MARC"].select(*READ["MARC"], "_row_id")}
    assert sorted(map(str, transform_table("MARC", lean).collect())) == sorted(map(str, transform_table("MARC", tables).collect()))


def test_a_target_plant_has_one_source_plant():
    """What lets equal target rows meet in the partition of their source key."""
    targets = [t for r in ROUTES for t in (r.external, r.inhouse) if t]
    assert len(targets) == len(set(targets))


def test_a_hot_key_is_split(spark):
    """Its join partition goes to several tasks, with an exchange by whole rows before the distinct."""
    _, tables = small_tables(spark)
    hot = tables["MARC"].filter("MATNR = '1' AND WERKS = '1025'").limit(1)
    copies = hot.crossJoin(spark.range(40000).repartition(8)).withColumn("LGPRO", F.sha1(F.col("id").cast("string"))).select(*hot.columns)
    cold = hot.crossJoin(spark.range(500)).withColumn("MATNR", F.concat(F.lit("M"), F.col("id"))).select(*hot.columns)
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    tune(spark)
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = transform_table("MARC", {**tables, "MARC": copies.unionByName(cold)})
        final = final_plan(found)
        rows = found.select("PRODUCT", "LGPRO").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len({r["LGPRO"] for r in rows if r["PRODUCT"] == "1"}) == 40000
    assert "skew=true" in final


def test_pairs_lie_where_the_transformation_left_them(spark):
    """Rows with their source keys are not shuffled again, and pair as rows without them do."""
    _, tables = small_tables(spark)
    keyed = pair_with_source(keyed_targets("MARC", tables), tables["MARC"])
    bare = pair_with_source(transform_table("MARC", tables), tables["MARC"])
    plan = keyed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(s_MATNR" not in plan and "hashpartitioning(PRODUCT" not in plan
    assert sorted(map(str, keyed.collect())) == sorted(map(str, bare.collect()))
    assert keyed.count() > 0 and keyed.filter("t_PRODUCT IS NULL").count() == 0


def test_quantities_are_read_once(spark):
    _, tables = small_tables(spark)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = transform_table("MARC", tables)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # one number pattern for each quantity, the ordering costs and the denominator
    assert plan.count("infinity") == 7
