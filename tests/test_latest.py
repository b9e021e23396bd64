"""The latest files, validated end to end over staged tables."""

import os

import pytest

from siteshift.plans.latest import validate_latest
from siteshift.sources import scan


def land(root, name, text, age=0):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_000_000 - age, 1_000_000 - age))


@pytest.fixture
def landed(tmp_path):
    land(tmp_path, "MARA/ECC/MARA_ECC_combined.csv", "MATNR,LVORM,MTART,MEINS,PRDHA\n001,,FERT,EA,x\n000,,NVAL,EA,x\n")
    land(tmp_path, "MARM/ECC/MARM_ECC_combined.csv", "MATNR,MEINH,UMREN\n1,EA,2\n")
    land(tmp_path, "MARC/ECC/MARC_ECC_combined_old.csv", "Material,Plant\n9,1025\n", age=50)
    land(tmp_path, "MARC/ECC/MARC_ECC_combined.csv", 'Material,Plant,MRP Type\n001,1025,"P\n1"\n000,1025,PD\n')
    land(tmp_path, "MARC/S4/MARC_S4_combined.csv", "PRODUCT,WERKS,DISMM\n1,US29,\n2,US29,PD\n")
    land(tmp_path, "MBEW/ECC/MBEW_ECC_combined.csv", "MATNR,BWKEY,ZPLD2,STPRS\n1,1025,2024-03-01,5\n")
    land(tmp_path, "MBEW/S4/MBEW_S4_combined.csv", "PRODUCT,BWKEY,BWTAR\n1,US29,\n")
    return str(tmp_path)


def test_rules_plants_and_report(spark, landed):
    staged = validate_latest(spark, landed, "MARC")
    assert [(r["PRODUCT"], r["WERKS"]) for r in staged.expected.collect()] == [("1", "US29")]  # the material of zeros is NVAL
    rules = {r["rule_id"]: r for r in staged.rules().collect()}
    assert rules["record_count"]["status"] == "pass" and rules["record_count"]["s4_row_count"] == 2
    assert [d["issue"] for d in rules["mandatory_completeness"]["details"] if d["field"] == "MRP Type"] == ["1 blank value(s)"]
    assert [(r["plant"], r["expected_rows"], r["actual_rows"]) for r in staged.by_plant().collect()] == [("US29", 1, 2)]
    report = staged.report().first()
    assert (report["ecc_row_count"], report["s4_row_count"], len(report["rules"])) == (2, 2, 4)
    assert len(staged.plant("us29", disabled=["record_count"]).collect()) == 3


def test_rules_read_written_tables_and_observed_counts(spark, landed):
    staged = validate_latest(spark, landed, "MARC")
    assert staged.quality.first()["actual_rows"] == 2
    plan = staged.rules()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "csv" not in plan.lower() and "_target" not in plan


def test_strict_dates(spark, landed):
    assert validate_latest(spark, landed, "MBEW").expected.first()["ZPLD2"] == "2024-03-01"
    assert validate_latest(spark, landed, "MBEW", strict_dates=True).expected.first()["ZPLD2"] is None


def test_missing_files(spark, landed, tmp_path):
    os.remove(tmp_path / "MBEW/S4/MBEW_S4_combined.csv")
    with pytest.raises(scan.ExtractNotFound):
        validate_latest(spark, landed, "MBEW")
