"""The preview against plain loops over small rows, and the shape of its plan."""

import re
from collections import Counter

from siteshift.layouts import MARC_TARGET, OTHER_RULE, RULE_TEXTS
from siteshift.operators import explain

FIELDS = ["WERKS", "DISMM", "LOSGR", "LGPRO", "BESKZ"]
GAPS = [("1", "US30", "LGPRO", "seen blank"), ("1", "US30", "DISMM", "b"), ("1", "US30", "DISMM", "a"), ("2", "US29", "BESKZ", "same")]


def paired(spark):
    """Source plant; source and target values of FIELDS; material and target plant."""
    rows = [
        ("1", "1021", "US30", (None, "P1", "5.0", "PL01", "E"), ("US30", "P1 ", "5", "", "F")),
        ("1", "1021", "US27", (None, None, "5", " ", "E"), ("US27", "", "1e1", None, "E")),
        ("2", "1025", "US29", (None, "nan", "inf", "x", "E"), ("US29", "nan", "Infinity", "X", "E")),
        ("2", "1025", "US29", (None, "nan", "inf", "x", "E"), ("US29", "nan", "Infinity", "X", "E")),
    ]
    kind = ", ".join(f"{f}:string" for f in FIELDS)
    return rows, spark.createDataFrame(
        [(m, p, m, w, s, t) for m, p, w, s, t in rows],
        f"s_MATNR string, s_WERKS string, t_PRODUCT string, t_WERKS string, s struct<{kind}>, t struct<{kind}>")


def number(v):
    try:
        return float(v) if v is not None and re.fullmatch(r"\s*[+-]?[0-9._einfty]+\s*", v, re.I) else None
    except ValueError:
        return None


def loops(rows):
    """(record, [(field, source, target, notes, label)]) of every row."""
    notes = {}
    for m, w, f, n in GAPS:
        notes.setdefault((m, w, f), set()).add(n)
    out = []
    for m, p, w, s, t in rows:
        changed, unchanged = [], []
        for f in sorted(FIELDS, key=MARC_TARGET.index):
            a, b = ((x or "").strip() or None for x in (p if f == "WERKS" else s[FIELDS.index(f)], t[FIELDS.index(f)]))
            same = a == b or (number(a) is not None and number(a) == number(b))
            note = "; ".join(sorted(notes.get((m, w, f), ())))
            if not same or note:
                (unchanged if same else changed).append((f, a, b, note, RULE_TEXTS.get(f, OTHER_RULE)[0]))
        out.append((f"{m}-{w}", changed + unchanged))
    return out


def only(monkeypatch):
    monkeypatch.setattr(explain, "MARC_TARGET", ["PRODUCT", *sorted(FIELDS, key=MARC_TARGET.index)])


def entry(f):
    return f["source_field"], f["source_value"], f["target_value"], f["notes"], f["rule_label"]


def test_records_and_changes_equal_loops(spark, monkeypatch):
    only(monkeypatch)
    rows, df = paired(spark)
    want = loops(rows)
    records = explain.preview_records(df, GAPS).collect()
    assert sorted((r["record_id"], [entry(f) for f in r["field_transformations"]]) for r in records) == sorted(want)
    assert {r["record_id"]: r["overall_status"] for r in records} == {r: "warning" if any(e[3] for e in es) else "success" for r, es in want}
    changes = explain.preview_changes(df, GAPS).collect()
    assert Counter((r["record_id"], *entry(r)) for r in changes) == Counter((r, *e) for r, es in want for e in es)
    assert all((r["validation_status"] == "warning") == bool(r["notes"]) for r in changes)


def test_report_counts_what_the_parts_hold(spark, monkeypatch):
    only(monkeypatch)
    rows, df = paired(spark)
    unmapped = spark.createDataFrame([("9", "1", "a"), ("8", "1", "a"), ("7", "1", None)], "MATNR string, ecc_plant string, reason string")
    report = explain.preview_report(df, unmapped, spark.range(9), GAPS)
    got = {(r["section"], r["label"]): (r["rows"], r["warnings"]) for r in report.collect()}
    entries = [e for _, es in loops(rows) for e in es]
    assert got["change", None] == (len(entries), sum(bool(e[3]) for e in entries))
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "change" and k[1]} == Counter(e[4] for e in entries)
    assert (got["record", None], got["source", None], got["unmapped", None], got["unmapped", "a"]) == ((4, 0), (9, 0), (3, 0), (2, 0))
    totals = explain.preview_totals(report).first()
    assert (totals["preview_record_count"], totals["ecc_rows_in"], totals["total_transformations"]) == (4, 9, len(entries))
    empty = explain.preview_totals(explain.preview_report(df.limit(0), unmapped.limit(0), spark.range(0), GAPS)).first()
    assert (empty["preview_record_count"], empty["success_rate"]) == (0, "n/a")


def test_comparison_stands_in_the_plan_once(spark, monkeypatch):
    only(monkeypatch)
    _, df = paired(spark)
    for out in (explain.preview_changes(df, GAPS), explain.preview_records(df, GAPS)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("infinity") in (2, 4)  # one number pattern for either side, twice where it is tested and read
        assert plan.count("Generate") <= 1


def test_report_reads_the_records_once(spark, monkeypatch):
    only(monkeypatch)
    _, df = paired(spark)
    unmapped = spark.createDataFrame([], "MATNR string, ecc_plant string, reason string")
    report = explain.preview_report(df, unmapped, spark.range(0), GAPS)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_entries_are_not_made_within_a_generator(spark, monkeypatch):
    only(monkeypatch)
    _, df = paired(spark)
    plan = explain.preview_changes(df, GAPS)._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.split("\n") if "Generate explode" in line)
    assert "coalesce(" not in generator and "_entries" in generator
