"""Data-quality and reconciliation rules on expected and actual target tables.

Two aggregates carry everything:

* ``field_quality``: one pass over the actual table, a handful of conditional counts per group.
* ``key_balance``: both tables reduced to (key, rows on each side) in one grouped union, then to
  a handful of sums. Copies of a key collapse before the shuffle.

Rules are expressions over those one-row (or one-row-per-plant) results, so a whole report is one
lazy plan, and by-plant validation is the same plan grouped by plant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteshift.functions.scalars import is_blank, is_date, is_number, match_key, plant_text, round_binary, too_long
from siteshift.mapping import TYPE_EXCEPTIONS, FieldMapping, Placed, SheetMapping

SEVERITY = {"pass": 0, "warning": 1, "fail": 2}
NO_DETAILS = "array()"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _entry(**values: Column | str) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs)


def _details(entries: Sequence[Column]) -> Column:
    if not entries:
        return F.expr(NO_DETAILS).cast("array<map<string,string>>")
    return F.array_compact(F.array(*entries))


def _rule(rule_id: str, name: str, status: Column | str, summary: Column | str, details: Column) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(name).alias("name"), col(status).alias("status"),
        col(summary).alias("summary"), details.alias("details"),
    )


def _signed(n: Column, zero_plus: bool = False) -> Column:
    return F.concat(F.when((n >= 0) if zero_plus else (n > 0), "+").otherwise(""), n.cast("string"))


# --------------------------------------------------------------------------- #
# Field quality: coverage, mandatory fields, type and length
# --------------------------------------------------------------------------- #

def _type_violated(c: Column, data_type: str | None) -> Column | None:
    if data_type == "Number":
        return ~is_number(c)
    if data_type == "Date":
        return ~is_date(c)
    return None


def _placed(columns: Sequence[str], mapping: Sequence[FieldMapping], sheet: str = "") -> list[Placed]:
    return SheetMapping(sheet, mapping, actual=columns).placed


def quality_counts(sheet: str, columns: Sequence[str], mapping: Sequence[FieldMapping]) -> list[Column]:
    """Conditional counts of every mapped field that has a column."""
    counts = [F.count(F.lit(1)).alias("actual_rows")]
    for i, placed in enumerate(_placed(columns, mapping)):
        if placed.actual is None:
            continue
        field, c = placed.field, _quoted(placed.actual).cast("string")
        if field.mandatory:
            counts.append(F.count_if(is_blank(c)).alias(f"blank_{i}"))
        if field.data_type == "Text" and field.length:
            counts.append(F.count_if(too_long(c, int(field.length))).alias(f"long_{i}"))
        violated = _type_violated(c, field.data_type)
        if violated is not None and (sheet, field.source_field) not in TYPE_EXCEPTIONS:
            counts.append(F.count_if(violated).alias(f"type_{i}"))
    return counts


def field_quality(sheet: str, actual: DataFrame, mapping: Sequence[FieldMapping],
                  by: Column | None = None) -> DataFrame:
    counts = quality_counts(sheet, actual.columns, mapping)
    return actual.agg(*counts) if by is None else actual.groupBy(by.alias("plant")).agg(*counts)


def _counted(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def field_coverage_rule(columns: Sequence[str], mapping: Sequence[FieldMapping]) -> Column:
    missing = SheetMapping("", mapping, actual=columns).missing
    name, n = "Field Coverage", len(mapping)
    if missing:
        return _rule("field_coverage", name, "fail",
                     f"{len(missing)} of {n} mapped field(s) missing from the S/4 file.",
                     _details([_entry(missing_field=m) for m in missing]))
    return _rule("field_coverage", name, "pass", f"All {n} mapped fields are present in the S/4 file.", _details([]))


def _issue_rule(rule_id: str, name: str, issues: Column, failed: Callable[[Column], Column], passed: str) -> Column:
    n = F.size(issues)
    return _rule(rule_id, name, F.when(n > 0, "fail").otherwise("pass"),
                 F.when(n > 0, failed(n)).otherwise(F.lit(passed)), issues)


def mandatory_rule(columns: Sequence[str], mapping: Sequence[FieldMapping]) -> Column:
    issues, mandatory = [], 0
    for i, placed in enumerate(_placed(columns, mapping)):
        field = placed.field
        if not field.mandatory:
            continue
        mandatory += 1
        if placed.actual is None:
            issues.append(_entry(field=field.s4_field, issue="column missing (see Field Coverage)"))
            continue
        blanks = _counted(f"blank_{i}")
        issues.append(F.when(blanks > 0, _entry(field=field.s4_field, issue=_text(blanks, " blank value(s)"))))
    return _issue_rule("mandatory_completeness", "Mandatory Field Completeness", _details(issues),
                       lambda n: _text(n, " mandatory field(s) have blank values."),
                       f"All {mandatory} mandatory fields are fully populated.")


def type_length_rule(sheet: str, columns: Sequence[str], mapping: Sequence[FieldMapping]) -> Column:
    issues, skipped = [], []
    for i, placed in enumerate(_placed(columns, mapping)):
        if placed.actual is None:
            continue
        field = placed.field
        if field.data_type == "Text" and field.length:
            n = _counted(f"long_{i}")
            issues.append(F.when(n > 0, _entry(
                field=field.s4_field, issue=_text(n, f" value(s) exceed max length {int(field.length)}"))))
        reason = TYPE_EXCEPTIONS.get((sheet, field.source_field))
        if reason:
            skipped.append(f"{field.s4_field} ({field.source_field}): {reason}")
        elif field.data_type in ("Number", "Date"):
            n = _counted(f"type_{i}")
            issues.append(F.when(n > 0, _entry(
                field=field.s4_field, issue=_text(n, f" value(s) don't match expected type '{field.data_type}'"))))
    passed = "All field values conform to the mapped data type and length."
    if skipped:
        passed += f" Known exception, type check skipped for: {'; '.join(skipped)}."
    return _issue_rule("type_length_conformance", "Data Type & Length Conformance", _details(issues),
                       lambda n: _text(n, " field(s) have type or length violations."), passed)


# --------------------------------------------------------------------------- #
# Record counts: key balance of both sides
# --------------------------------------------------------------------------- #

def key_counts(sheet: str, expected: DataFrame, actual: DataFrame, mapping: Sequence[FieldMapping],
               by_plant: bool = False) -> DataFrame:
    """([plant,] key, n_expected, n_actual): rows of every key on both sides."""
    parts = SheetMapping(sheet, mapping, expected.columns, actual.columns).key_parts
    if parts is None:
        raise ValueError(f"key fields of {sheet} are not resolvable on both sides")

    def side(df: DataFrame, position: int) -> DataFrame:
        key = match_key([(p[0], _quoted(p[position]).cast("string")) for p in parts]).alias("key")
        flags = [F.lit(int(position == n)).cast("bigint").alias(c) for n, c in ((1, "n_expected"), (2, "n_actual"))]
        return df.select(*([plant_column(sheet, df, mapping).alias("plant")] if by_plant else []), key, *flags)

    keys = (["plant"] if by_plant else []) + ["key"]
    both = side(expected, 1).unionByName(side(actual, 2))
    return both.groupBy(*keys).agg(F.sum("n_expected").alias("n_expected"), F.sum("n_actual").alias("n_actual"))


def balance_sums() -> list[Column]:
    """Headline numbers over per-key counts."""
    in_expected, in_actual = F.col("n_expected") > 0, F.col("n_actual") > 0
    common = in_expected & in_actual
    zero = F.lit(0).cast("bigint")
    return [
        F.coalesce(F.sum("n_expected"), zero).alias("n_expected"),
        F.coalesce(F.sum("n_actual"), zero).alias("n_actual"),
        F.count_if(in_expected).alias("expected_keys"),
        F.count_if(in_actual).alias("actual_keys"),
        F.count_if(common).alias("common_keys"),
        F.coalesce(F.sum(F.when(common, F.col("n_expected"))), zero).alias("common_expected_rows"),
        F.coalesce(F.sum(F.when(common, F.col("n_actual"))), zero).alias("common_actual_rows"),
    ]


def key_balance(sheet: str, expected: DataFrame, actual: DataFrame, mapping: Sequence[FieldMapping],
                by_plant: bool = False) -> DataFrame:
    counts = key_counts(sheet, expected, actual, mapping, by_plant)
    return counts.groupBy("plant").agg(*balance_sums()) if by_plant else counts.agg(*balance_sums())


def duplicate_rows(sheet: str, df: DataFrame, mapping: Sequence[FieldMapping]) -> DataFrame:
    """Rows of one table beyond the first of their key, as one row."""
    parts = SheetMapping(sheet, mapping, df.columns, df.columns).key_parts
    if parts is None:
        raise ValueError(f"key fields of {sheet} are not resolvable")
    key = match_key([(p[0], _quoted(p[1]).cast("string")) for p in parts])
    counts = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("duplicate_rows"))


def plant_row_balance(sheet: str, expected: DataFrame, actual: DataFrame, mapping: Sequence[FieldMapping]) -> DataFrame:
    """Row counts of both sides per plant, without keys."""
    def side(df: DataFrame, e: int, a: int) -> DataFrame:
        return df.select(plant_column(sheet, df, mapping).alias("plant"), F.lit(e).cast("bigint").alias("e"), F.lit(a).cast("bigint").alias("a"))

    both = side(expected, 1, 0).unionByName(side(actual, 0, 1))
    return both.groupBy("plant").agg(F.sum("e").alias("n_expected"), F.sum("a").alias("n_actual"))


def row_balance(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Row counts of both sides as one row, without keys."""
    def side(df: DataFrame, e: int, a: int) -> DataFrame:
        n = F.count(F.lit(1))
        return df.agg((n * e).alias("n_expected"), (n * a).alias("n_actual"))

    both = side(expected, 1, 0).unionByName(side(actual, 0, 1))
    return both.agg(F.sum("n_expected").alias("n_expected"), F.sum("n_actual").alias("n_actual"))


def breakdown_columns() -> dict[str, Column]:
    c = F.col
    return {
        "keys_only_in_actual": c("actual_keys") - c("common_keys"),
        "keys_only_in_expected": c("expected_keys") - c("common_keys"),
        "extra_duplicate_rows_actual": c("n_actual") - c("actual_keys"),
        "extra_duplicate_rows_expected": c("n_expected") - c("expected_keys"),
    }


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_binary(part / whole * 100, 1)).otherwise(F.lit(0.0))


def common_key_columns() -> dict[str, Column]:
    c = F.col
    return {
        "common_keys": c("common_keys"),
        "expected_keys": c("expected_keys"),
        "actual_keys": c("actual_keys"),
        "pct_of_expected": _share(c("common_keys"), c("expected_keys")),
        "pct_of_actual": _share(c("common_keys"), c("actual_keys")),
    }


def common_count_rule() -> Column:
    """Rule on rows of common keys; NULL where those differ, so the full rule decides."""
    stats = common_key_columns()
    rows = F.col("common_expected_rows")
    summary = _text(
        "Row counts match on the ", F.format_number("common_keys", 0), " common key(s): ",
        F.format_number(rows, 0), " row(s) on both sides. Coverage: ", stats["pct_of_actual"],
        "% of Actual keys, ", stats["pct_of_expected"], "% of Expected keys.")
    return F.when(rows == F.col("common_actual_rows"),
                  _rule("record_count", "Record Count Reconciliation", "pass", summary, F.array(_entry(**stats))))


def full_count_rule(tolerance_pct: float = 0.0, explained: bool = True) -> Column:
    """Rule on all rows: equal, or a delta explained by its key-level causes."""
    n_exp, n_act = F.col("n_expected"), F.col("n_actual")
    delta = n_act - n_exp
    pct = F.when(n_exp > 0, F.abs(delta) / n_exp * 100).otherwise(F.lit(100.0))
    tolerance_pct = max(0.0, float(tolerance_pct))
    within = (F.lit(tolerance_pct) > 0) & (pct <= tolerance_pct)
    causes = breakdown_columns() if explained else {}
    mismatch = [_text("Row count mismatch: ", n_exp, " Expected S/4 row(s) vs ", n_act, " Actual S/4 row(s) (",
                      _signed(delta), ").")]
    if explained:
        duplicates = causes["extra_duplicate_rows_actual"] - causes["extra_duplicate_rows_expected"]
        mismatch.append(_text(" Explained by keys: +", causes["keys_only_in_actual"], " only in Actual, -",
                              causes["keys_only_in_expected"], " only in Expected, ",
                              _signed(duplicates, zero_plus=True), " duplicate row(s)."))
    mismatch.append(F.when(within, _text(f" Within the configured tolerance of {tolerance_pct}% (",
                                         F.format_string("%.2f", pct), "%).")).otherwise(""))
    detail = _entry(expected_row_count=n_exp, actual_row_count=n_act, delta=delta,
                    **causes, delta_pct=round_binary(pct, 2), tolerance_pct=str(tolerance_pct))
    equal = n_exp == n_act
    return _rule(
        "record_count", "Record Count Reconciliation",
        F.when(equal, "pass").when(within, "warning").otherwise("fail"),
        F.when(equal, _text("Row counts match: ", n_exp,
                            " in both Expected S/4 (transformed from ECC) and Actual S/4."))
        .otherwise(F.concat(*mismatch)),
        F.when(equal, _details([])).otherwise(F.array(detail)),
    )


def count_rule(scope: str = "common_keys", tolerance_pct: float = 0.0, keyed: bool = True) -> Column:
    full = full_count_rule(tolerance_pct, explained=keyed)
    return F.coalesce(common_count_rule(), full) if scope == "common_keys" and keyed else full


def direct_count_rule() -> Column:
    """Row counts of a raw source file against a target file."""
    n_src, n_tgt = F.col("n_expected"), F.col("n_actual")
    delta = n_tgt - n_src
    equal = n_src == n_tgt
    return _rule(
        "record_count", "Record Count Reconciliation", F.when(equal, "pass").otherwise("fail"),
        F.when(equal, _text("Row counts match: ", n_src, " in both ECC and S/4."))
        .otherwise(_text("Row count mismatch: ", n_src, " ECC row(s) vs ", n_tgt, " S/4 row(s) (",
                         _signed(delta), ").")),
        F.when(equal, _details([])).otherwise(
            F.array(_entry(ecc_row_count=n_src, s4_row_count=n_tgt, delta=delta))),
    )


# --------------------------------------------------------------------------- #
# Plants
# --------------------------------------------------------------------------- #

def plant_column(sheet: str, df: DataFrame, mapping: Sequence[FieldMapping]) -> Column:
    """Plant of a target row as trimmed upper-case text; NULL when the column is not there."""
    plant = SheetMapping(sheet, mapping, actual=df.columns).plant
    if plant is None or plant.actual is None:
        return F.lit(None).cast("string")
    return plant_text(_quoted(plant.actual).cast("string"))


def filter_by_plant(sheet: str, df: DataFrame, plant: str, mapping: Sequence[FieldMapping]) -> DataFrame:
    return df.filter(plant_column(sheet, df, mapping) == plant.strip().upper())


def list_plants(sheet: str, mapping: Sequence[FieldMapping], *frames: DataFrame) -> DataFrame:
    """Distinct plants of all frames, in order."""
    plants = [df.select(plant_column(sheet, df, mapping).alias("plant")) for df in frames]
    union = plants[0]
    for p in plants[1:]:
        union = union.unionByName(p)
    return union.filter(F.col("plant") != "").distinct().orderBy("plant")


# --------------------------------------------------------------------------- #
# Overall status
# --------------------------------------------------------------------------- #

def severity(status: Column) -> Column:
    return F.when(status == "fail", SEVERITY["fail"]).when(status == "warning", SEVERITY["warning"]).otherwise(
        SEVERITY["pass"])


def status_of(level: Column) -> Column:
    return F.when(level == SEVERITY["fail"], "fail").when(level == SEVERITY["warning"], "warning").otherwise("pass")


def rules_passed(rules: DataFrame) -> DataFrame:
    """Passed and total rules, worst status."""
    return rules.agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        status_of(F.max(severity(F.col("status")))).alias("overall_status"),
    )

