"""Reconciliation rules and header resolution on small cases."""

from siteshift.mapping import DEFAULT_MAPPING
from siteshift.operators import reconcile as r
from siteshift.plans.validate import report, validate_by_plant, validate_expected_actual
from siteshift.sources.normalize import normalize_extract, resolve_header
from siteshift.sources.scan import dedup_header, matches

SCHEMA = "PRODUCT string, WERKS string, DISMM string, MMSTA string, MMSTD string, EKGRP string, LOSGR string, BSTMI string, LGPRO string"


def target(spark, keys):
    return spark.createDataFrame([(p, w, "PD", "01", None, "", "1", "1", "L1") for p, w in keys], SCHEMA)


def rules(spark, expected, actual, **options):
    out = validate_expected_actual("MARC", target(spark, expected), target(spark, actual), **options)
    return {row["rule_id"]: row for row in out.collect()}


def test_no_common_keys_pass_with_zero_coverage(spark):
    row = rules(spark, [("1", "US29")], [("2", "US29"), ("3", "US29")])["record_count"]
    assert row["status"] == "pass" and "Coverage: 0.0% of Actual keys, 0.0% of Expected keys." in row["summary"]


def test_leading_zeros_and_case_still_match(spark):
    row = rules(spark, [("12", "US29")], [("00012", " us29 ")])["record_count"]
    assert row["status"] == "pass" and "1 common key(s)" in row["summary"]


def test_delta_within_tolerance_is_a_warning(spark):
    expected, actual = [("1", "A"), ("2", "A")], [("1", "A"), ("1", "A"), ("2", "A")]
    assert rules(spark, expected, actual)["record_count"]["status"] == "fail"
    row = rules(spark, expected, actual, tolerance_pct=50)["record_count"]
    assert row["status"] == "warning" and "Within the configured tolerance of 50.0% (50.00%)." in row["summary"]
    detail = row["details"][0]
    assert int(detail["delta"]) == (int(detail["keys_only_in_actual"]) - int(detail["keys_only_in_expected"])
                                    + int(detail["extra_duplicate_rows_actual"]) - int(detail["extra_duplicate_rows_expected"]))


def test_report_and_by_plant(spark):
    expected, actual = target(spark, [("1", "A"), ("2", "B")]), target(spark, [("1", "A"), ("", "B"), ("3", "C")])
    row = report("MARC", validate_expected_actual("MARC", expected, actual), expected).first()
    assert row["overall_status"] == "fail" and row["ecc_row_count"] == 2 and row["s4_row_count"] == 3
    assert [x["rule_id"] for x in row["rules"]] == ["field_coverage", "mandatory_completeness", "type_length_conformance", "record_count"]
    plants = {p["plant"]: p for p in validate_by_plant("MARC", expected, actual).collect()}
    assert {p: x["overall_status"] for p, x in plants.items()} == {"A": "pass", "B": "fail", "C": "pass"}


def test_unresolvable_keys_compare_row_counts(spark):
    expected = target(spark, [("1", "A")]).drop("PRODUCT")
    out = validate_expected_actual("MARC", expected, target(spark, [("1", "A")])).filter("rule_id = 'record_count'").first()
    assert out["status"] == "pass" and out["records_validated"] is None


def test_headers():
    assert dedup_header(["a", "a", "a.1", "", "a"]) == ["a", "a.2", "a.1", "Unnamed: 3", "a.3"]
    kept, missing = resolve_header(["Material", "matnr", "MEINH"], "MARM")
    assert kept == [(0, "MATNR"), (2, "MEINH")] and missing == ["UMREN"]
    assert matches("S_MARC#FreeText - 1.CSV", "S_MARC#FreeText", [".csv"]) and not matches("s_marc.csv", "S_MARC", [".csv"])


def test_names_differing_in_case_only(spark):
    """Labels: both names resolve and the first column is kept. Aliases: the last such name is the hit."""
    df = spark.createDataFrame([("007.0", "x", " EA ")], "a string, b string, c string").toDF("Material", "MATERIAL", "meinh")
    assert normalize_extract(df, "MARC", required_only=True).first()["MATNR"] == "7"
    assert normalize_extract(df, "MARM", required_only=True).first().asDict() == {"MATNR": "x", "MEINH": "EA", "UMREN": None}


def test_quality_counts_cover_the_mapping(spark):
    facts = r.field_quality("MARC", target(spark, [("1", "A")]), DEFAULT_MAPPING["MARC"]).first().asDict()
    assert facts["actual_rows"] == 1 and facts["type_4"] == 0
