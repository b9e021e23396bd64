"""Validation reports as lazy plans: rules, one-row reports and the by-plant overview."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteshift.mapping import DEFAULT_MAPPING, FieldMapping, SheetMapping
from siteshift.operators import reconcile as r


def _rows(facts: DataFrame, rules: Sequence[tuple[int, Column]], **numbers: Column) -> DataFrame:
    """One row per rule over a one-row table of facts."""
    listed = F.array(*[F.struct(F.lit(i).alias("position"), rule.alias("rule")) for i, rule in rules])
    return facts.select(F.explode(listed).alias("entry"), *[c.alias(n) for n, c in numbers.items()]).select(
        "entry.position", "entry.rule.*", *numbers)


def _quality_rows(sheet: str, actual: DataFrame, mapping: Sequence[FieldMapping], quality: DataFrame | None = None) -> DataFrame:
    rules = [
        r.field_coverage_rule(actual.columns, mapping),
        r.mandatory_rule(actual.columns, mapping),
        r.type_length_rule(sheet, actual.columns, mapping),
    ]
    unknown = F.lit(None).cast("bigint")
    facts = r.field_quality(sheet, actual, mapping) if quality is None else quality
    return _rows(facts, list(enumerate(rules, 1)),
                 s4_row_count=F.col("actual_rows"), records_validated=unknown)


def validate_expected_actual(sheet: str, expected: DataFrame, actual: DataFrame,
                             mapping: Sequence[FieldMapping] | None = None, scope: str = "common_keys",
                             tolerance_pct: float = 0.0, disabled: Collection[str] = (),
                             quality: DataFrame | None = None) -> DataFrame:
    """One row per rule: expected target (transformed source) against the actual one.

    ``quality``: the field counts of the actual table where they are known already.
    """
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    keyed = SheetMapping(sheet, mapping, expected.columns, actual.columns).key_parts is not None
    facts = r.key_balance(sheet, expected, actual, mapping) if keyed else r.row_balance(expected, actual)
    counted = _rows(facts, [(4, r.count_rule(scope, tolerance_pct, keyed))],
                    s4_row_count=F.col("n_actual"),
                    records_validated=F.col("common_keys") if keyed else F.lit(None).cast("bigint"))
    rules = _quality_rows(sheet, actual, mapping, quality).unionByName(counted)
    return rules.filter(~F.col("rule_id").isin(*disabled)) if disabled else rules


def validate_direct(sheet: str, source: DataFrame, target: DataFrame,
                    mapping: Sequence[FieldMapping] | None = None) -> DataFrame:
    """One row per rule: a raw source file against a target file, row counts only."""
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    counted = _rows(r.row_balance(source, target), [(4, r.direct_count_rule())],
                    s4_row_count=F.col("n_actual"), records_validated=F.lit(None).cast("bigint"))
    return _quality_rows(sheet, target, mapping).unionByName(counted)


def validate_plant(sheet: str, expected: DataFrame, actual: DataFrame, plant: str,
                   mapping: Sequence[FieldMapping] | None = None, **options) -> DataFrame:
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    return validate_expected_actual(sheet, r.filter_by_plant(sheet, expected, plant, mapping),
                                    r.filter_by_plant(sheet, actual, plant, mapping), mapping, **options)


def report(sheet: str, rules: DataFrame, source: DataFrame,
           mapping: Sequence[FieldMapping] | None = None) -> DataFrame:
    """The rules of one validation as a single report row, with the raw source row count."""
    columns = ["position", "rule_id", "name", "status", "summary", "details", "s4_row_count", "records_validated"]
    counted = source.agg(F.count(F.lit(1)).alias("ecc_row_count"))
    rows = rules.select(*columns).unionByName(counted, allowMissingColumns=True)
    return report_row(sheet, rows, F.max("ecc_row_count"), mapping)


def report_row(sheet: str, rows: DataFrame, source_rows: Column, mapping: Sequence[FieldMapping] | None = None) -> DataFrame:
    """One report row of rules; ``source_rows`` is a constant or an aggregate over them."""
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    entry = F.struct("position", "rule_id", "name", "status", "summary", "details")
    return rows.agg(
        F.lit(sheet).alias("sheet"),
        F.array(*[F.lit(k) for k in SheetMapping(sheet, mapping).key_labels]).alias("key_fields"),
        source_rows.alias("ecc_row_count"),
        F.max("s4_row_count").alias("s4_row_count"),
        F.max("records_validated").alias("records_validated"),
        r.status_of(F.max(r.severity(F.col("status")))).alias("overall_status"),
        # four rules at most
        F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), entry)),
                     lambda a, b: a["position"] - b["position"]).alias("rules"),
    )


def validate_by_plant(sheet: str, expected: DataFrame, actual: DataFrame,
                      mapping: Sequence[FieldMapping] | None = None, scope: str = "common_keys",
                      tolerance_pct: float = 0.0) -> DataFrame:
    """One row per plant with the status of every rule, in one grouped plan for all plants."""
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    quality = r.field_quality(sheet, actual, mapping, by=r.plant_column(sheet, actual, mapping))
    keyed = SheetMapping(sheet, mapping, expected.columns, actual.columns).key_parts is not None
    if keyed:
        balance = r.key_balance(sheet, expected, actual, mapping, by_plant=True)
    else:  # keys that a side lacks leave plain row counts to compare
        balance = r.plant_row_balance(sheet, expected, actual, mapping)
    rules = {
        "field_coverage": r.field_coverage_rule(actual.columns, mapping),
        "mandatory_completeness": r.mandatory_rule(actual.columns, mapping),
        "type_length_conformance": r.type_length_rule(sheet, actual.columns, mapping),
        "record_count": r.count_rule(scope, tolerance_pct, keyed),
    }
    statuses = {name: rule["status"] for name, rule in rules.items()}
    worst = F.greatest(*[r.severity(s) for s in statuses.values()])
    return balance.filter(F.col("plant") != "").join(quality, "plant", "left").select(
        "plant",
        F.col("n_expected").alias("expected_rows"),
        F.col("n_actual").alias("actual_rows"),
        r.status_of(worst).alias("overall_status"),
        F.create_map(*[x for name, s in statuses.items() for x in (F.lit(name), s)]).alias("rules"),
    )
