"""What asks for keys alone, or for single rows of a key, takes no wide rows through a shuffle."""

import pytest

import __spark_entry__ as contract
from siteshift.mapping import DEFAULT_MAPPING
from siteshift.operators import explain
from siteshift.operators import reconcile as r
from siteshift.plans.transform import expected_plants, transform_table
from siteshift.session import tune
from siteshift.sources import records
from tests.test_transform import small_tables
from workload import reconciliation

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_the_expected_table_equal_those_of_its_rows(spark):
    _, tables = small_tables(spark)
    for groups in (None, ["1021"], ["1025", "1000_1029"]):
        got = [tuple(x) for x in expected_plants("MARC", tables, groups).select("PRODUCT", "WERKS").collect()]
        want = {tuple(x) for x in transform_table("MARC", tables, groups).select("PRODUCT", "WERKS").collect()}
        assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["anti_unmapped", "preview_unmapped", "preview_reason_counts", "plant_reverse_map", "anti_keys_expected",
                                  "anti_keys_actual", "join_keys_common", "preview_requests"])
def test_key_queries_read_no_field_of_the_rows(spark, name):
    plan = optimized(contract.queries()[name](spark, SF))
    assert "LGPRO" not in plan and "DISPO" not in plan


def test_rows_of_a_key_with_equal_ids_are_paired_once(spark):
    source = spark.createDataFrame([("1", "1025", "a", "7"), ("1", "1025", "a", "7"), ("1", "1025", "b", "8")],
                                   "MATNR string, WERKS string, LGPRO string, _row_id string")
    expected = spark.createDataFrame([("1", "US29", "x")], "PRODUCT string, WERKS string, LGPRO string")
    assert [x["s"]["LGPRO"] for x in explain.pair_with_source(expected, source).collect()] == ["a"]


def test_first_rows_are_told_before_the_shuffle(spark):
    source = spark.createDataFrame([("1", "1025", "a", "7")], "MATNR string, WERKS string, LGPRO string, _row_id string")
    expected = spark.createDataFrame([("1", "US29", "x")], "PRODUCT string, WERKS string, LGPRO string")
    plan = explain.pair_with_source(expected, source)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_known_gaps_read_their_materials_only(spark):
    query = contract.queries()["preview_known_gaps"](spark, SF)
    assert "_named" in optimized(query)
    found = contract.queries()["preview_changes"](spark, SF).filter("validation_status = 'warning'").select(*query.columns)
    assert found.count() > 0 and sorted(map(tuple, query.collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)


def test_duplicate_rows_of_one_table(spark):
    rows = spark.createDataFrame([("01", "US30"), ("1", "us30 "), ("1", "US27"), (None, None), (None, "")], "PRODUCT string, WERKS string")
    assert r.duplicate_rows("MARC", rows, DEFAULT_MAPPING["MARC"]).collect()[0][0] == 2
    assert r.duplicate_rows("MARC", rows.limit(0), DEFAULT_MAPPING["MARC"]).collect()[0][0] == 0


def test_merged_extracts_are_written_once_with_their_keys(spark, monkeypatch):
    seen, write = [], reconciliation.written
    monkeypatch.setattr(reconciliation, "written", lambda df, what: seen.append(df.columns) or write(df, what))
    reconciliation._merged_state(spark, SF, "MARC")
    assert seen == [["PRODUCT", "WERKS", "_extract", "_side"]]


def test_ranges_of_a_file_are_one_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n" + "1,2\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.sparkContext.setJobGroup("ranges", "ranges")
    try:
        layout = records.layout_of(spark, [str(tmp_path / "a.csv")])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ranges")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert layout.rows == 5000 and len(layout.base) > 1 and len(jobs) == 1


def test_wide_rows_get_smaller_tasks_and_documents_do_not(spark):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    try:
        tune(spark, wide_rows=False)
        default = [spark.conf.get(n) for n in names]
        contract.queries()["transform_marc"](spark, SF)
        assert [spark.conf.get(n) for n in names] == ["16m", "16m"] != default
        tune(spark, wide_rows=False)
        assert [spark.conf.get(n) for n in names] == default
    finally:
        tune(spark)


@pytest.mark.parametrize("name", ["list_plants", "common_key_stats"])
def test_plants_and_common_keys_read_no_field_of_the_rows(spark, name):
    plan = optimized(contract.queries()[name](spark, SF))
    assert "LGPRO" not in plan and "DISPO" not in plan
