"""Pairs of one packed shuffle against the pairing of the transformation with its source, and their plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siteshift.operators.explain import pair_with_source
from siteshift.plans.preview import paired_targets, transformation_preview
from siteshift.plans.transform import keyed_targets
from tests.test_transform import small_tables


def odd_tables(spark, ids):
    """Source rows of which the first may be deleted, with cells that a text of all cells has to keep apart."""
    _, tables = small_tables(spark)
    n = F.col("_row_id").cast("int")
    odd = F.element_at(F.array(*[F.lit(x) for x in ('a"b', "null", "", "[\\", "x\n,y", "\u0001é")]), n % 6 + 1)
    rows = tables["MARC"].withColumn("LGPRO", odd).withColumn("DISMM", F.when(n % 3 > 0, odd))
    rows = rows.withColumn("LVORM", F.when(n % 4 == 0, "X")).withColumn("_row_id", ids(n))
    return {**tables, "MARC": rows}


@pytest.mark.parametrize("ids", [lambda n: F.lpad(n.cast("string"), 6, "0"), lambda n: (40 - n).cast("long"), lambda n: F.when(n % 2 > 0, n.cast("long"))])
def test_packed_pairs_equal_pairs_of_the_transformation(spark, ids):
    tables = odd_tables(spark, ids)
    key_of_row = lambda rows: Counter((r["t_PRODUCT"], r["t_WERKS"], r["s_WERKS"], r["t"], r["s"]) for r in rows)
    want = key_of_row(pair_with_source(keyed_targets("MARC", tables), tables["MARC"]).collect())
    assert want and key_of_row(paired_targets(tables).collect()) == want


def test_first_rows_without_ids_are_paired_once(spark):
    tables = odd_tables(spark, lambda n: F.lit(None).cast("long"))
    assert paired_targets(tables).count() == keyed_targets("MARC", tables).filter("PRODUCT IS NOT NULL").count()


def test_records_read_one_wide_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = transformation_preview(odd_tables(spark, lambda n: n.cast("long"))).records
        records.collect()
        final = records._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("explode([0])") == 1 and "ReusedExchange" in final


def test_constant_fields_are_not_joined(spark):
    tables = odd_tables(spark, lambda n: n.cast("long"))
    plan = paired_targets(tables)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "CG01" in above and "CG01" not in below
