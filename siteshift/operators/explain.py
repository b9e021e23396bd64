"""Field-level explanation of a transformation: what each rule changed, and what produced nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteshift.functions.scalars import (
    WHITESPACE,
    blank_to_null,
    blank_to_null_sql,
    float_value,
    fmt_num,
    material_key,
    null_safe_key,
    num,
    round_binary,
    same,
    strip_zeros,
)
from siteshift.layouts import KNOWN_GAPS, MARC_BLANK, MARC_PASS, MARC_TARGET, OTHER_RULE, PAIR_FIELDS, ROUTES, RULE_TEXTS
from siteshift.operators.lookups import KEYS, ROW_ID, last_per_key, own_exchange
from siteshift.operators.plants import lookup, target_to_source

Gap = tuple[str, str, str, str]
SUMMARY_FIELDS = [*PAIR_FIELDS, "LOSGR"]
NO_TEXT = "cast(NULL AS STRING)"


def _raw_source(field: str, columns: Sequence[str]) -> str:
    if field == "WERKS":
        return "s_WERKS"
    return f"s.`{field}`" if field in columns else NO_TEXT


def _target(field: str) -> Column:
    return blank_to_null(F.col(f"t.{field}"))


def _source(field: str, columns: Sequence[str]) -> Column:
    return blank_to_null(F.expr(_raw_source(field, columns)))


def source_fields(paired: DataFrame) -> list[str]:
    return paired.schema["s"].dataType.names


def _text(value: str | None) -> str:
    if value is None:
        return NO_TEXT
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gap_table(spark: SparkSession, gaps: Sequence[Gap]) -> DataFrame:
    """Known gaps (material, target plant, field, note) as literal rows, whose size the planner knows exactly."""
    rows = ", ".join(f"({', '.join(_text(x) for x in g)})" for g in gaps) or "(NULL, NULL, NULL, NULL)"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS gap(material, plant, field, note) WHERE material IS NOT NULL").select(
        *[F.col(c).cast("string").alias(c) for c in ("material", "plant", "field", "note")])


def with_gaps(paired: DataFrame, gaps: DataFrame | Sequence[Gap]) -> DataFrame:
    """``_gaps``: notes by field of the known gaps of a paired row, NULL without any. Several notes are joined.

    A given list is grouped here, so its literal rows join as they are and paired rows stay where they are. A table
    of any size is grouped and joined by its key.
    """
    if isinstance(gaps, DataFrame):
        one = gaps.groupBy("material", "plant", "field").agg(F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("note"))
    else:
        notes: dict[tuple, set[str]] = {}
        for material, plant, field, note in gaps:
            notes.setdefault((material, plant, field), set()).add(note)
        one = gap_table(paired.sparkSession, [(*key, "; ".join(sorted(texts))) for key, texts in notes.items()])
    by_key = one.groupBy(F.col("material").alias("t_PRODUCT"), F.col("plant").alias("t_WERKS")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "note"))).alias("_gaps"))
    return paired.join(by_key, ["t_PRODUCT", "t_WERKS"], "left")


def gap_note(field: Column | str) -> Column:
    """Note of a known gap on this record and field, else NULL."""
    return F.try_element_at("_gaps", field if isinstance(field, Column) else F.lit(field))


def pair_with_source(expected: DataFrame, source: DataFrame,
                     fields: Sequence[str] = MARC_TARGET) -> DataFrame:
    """Every expected row with its first source row: keys, and the wanted fields as structs ``t`` and ``s``.

    ``source`` is a normalised plant-data extract with an ingest row id. Every reading task keeps its first row of a
    key, and only those are shuffled. Expected rows that still have their source keys (``keyed_targets``) lie by
    them and are not shuffled again. Two structs rather than some 260 renamed columns keep the optimizer's
    work on the plan small.
    """
    rows = routed_rows(source).select(*KEYS, ROW_ID, F.struct(*source_wanted(source, fields)).alias("s"))
    by_id = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last(ROW_ID))
    first = rows.withColumn("_rank", F.row_number().over(by_id)).filter(F.col("_rank") == 1).select(*KEYS, "s")
    keyed = expected if set(KEYS) <= set(expected.columns) else expected.withColumns(
        {"_key": null_safe_key(F.col("PRODUCT")), "_source": lookup(F.col("WERKS"), target_to_source())})
    return pair_by_keys(keyed.filter(F.col("PRODUCT").isNotNull()), first, fields)


def routed_rows(source: DataFrame) -> DataFrame:
    """Source rows of routed plants with their keys."""
    return source.filter(F.col("WERKS").isin(*[r.source for r in ROUTES])).withColumns(
        {"_key": null_safe_key(F.col("MATNR")), "_source": F.col("WERKS")})


def source_wanted(source: DataFrame, fields: Sequence[str]) -> list[str]:
    """Source fields of a pair besides its keys; a struct needs one at least."""
    return [c for c in source.columns if c in fields and c not in ("MATNR", "WERKS")] or [ROW_ID]


def first_ids(source: DataFrame) -> DataFrame:
    """(_key, _source, _first): the smallest row id of each key, NULL where no row of it has one. No wide row is shuffled."""
    by_id = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last(ROW_ID))
    ranked = routed_rows(source).select(*KEYS, F.col(ROW_ID)).withColumn("_rank", F.row_number().over(by_id))
    return ranked.filter(F.col("_rank") == 1).select(*KEYS, F.col(ROW_ID).alias("_first"))


def pair_by_keys(keyed: DataFrame, first: DataFrame, fields: Sequence[str] = MARC_TARGET,
                 constants: Mapping[str, Column] | None = None) -> DataFrame:
    """Expected rows and the first source row (struct ``s``) of their keys.

    ``constants``: fields with one value in every expected row. They are added behind the join, so it copies no column of
    them, and what compares them is worked out while planning.
    """
    told = constants or {}
    wanted = [c for c in keyed.columns if c in fields]
    varying = [c for c in wanted if c not in told]
    target = keyed.select(*KEYS, F.col("PRODUCT").alias("t_PRODUCT"), F.col("WERKS").alias("t_WERKS"),
                          *([F.struct(*varying).alias("t")] if varying else []))
    t = F.struct(*[(F.col(f"t.{c}") if c in varying else told[c]).alias(c) for c in wanted])
    return target.join(first, KEYS).select(F.col("t_PRODUCT").alias("s_MATNR"), F.col("_source").alias("s_WERKS"), "t_PRODUCT", "t_WERKS",
                                           t.alias("t"), "s")


# --------------------------------------------------------------------------- #
# Field changes
# --------------------------------------------------------------------------- #

def _compared_fields(fields: Sequence[str]) -> list[str]:
    return [f for f in MARC_TARGET if f != "PRODUCT" and f in fields]


def _entries(columns: Sequence[str], fields: Sequence[str]) -> Column:
    """Array with an entry per field worth comparing, its values trimmed; other places are NULL.

    Worth comparing is text that differs, NULL being empty, and every field of a record with known gaps: no entry is
    made of the many others. ``pos`` is the field's place in target order. Fields that the extract lacks and no rule
    fills are one branch, taken where a gap is known or the target has a text all the same. One parsed text: hundreds of
    Column calls would take longer to make than the query to plan.
    """
    compared = [(i, f, _raw_source(f, columns)) for i, f in enumerate(_compared_fields(fields))]

    def value(text: str) -> str:
        return text if text == NO_TEXT else blank_to_null_sql(text, "_spaces")

    def entries(some) -> str:
        return "array(" + ", ".join(
            f"CASE WHEN _gaps IS NOT NULL OR coalesce({source}, '') <> coalesce(t.`{f}`, '') THEN "
            f"named_struct('pos', {i}, 'source_value', {value(source)}, 'target_value', {value(f't.`{f}`')}) END"
            for i, f, source in some) + ")"

    unfilled = [x for x in compared if x[1] not in columns and x[1] in (*MARC_PASS, *MARC_BLANK)]
    rest = [x for x in compared if x not in unfilled]
    parts = [entries(rest)] if rest else []
    if unfilled:
        told = " OR ".join(f"coalesce(t.`{f}`, '') <> ''" for _, f, _ in unfilled)
        parts.append(f"CASE WHEN _gaps IS NOT NULL OR {told} THEN {entries(unfilled)} ELSE array() END")
    return F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")


def _by_position(texts: Sequence[str], pos: Column) -> Column:
    """The text of a compared field; small constant arrays of the rule book."""
    return F.get(F.array(*[F.lit(x) for x in texts]), pos)


def _field_of(pos: Column, fields: Sequence[str] = MARC_TARGET) -> Column:
    return _by_position(_compared_fields(fields), pos)


def with_entries(paired: DataFrame, fields: Sequence[str] = MARC_TARGET) -> DataFrame:
    """``_entries`` in a projection of its own, where it is compiled: a generator or lambda over it would interpret it."""
    spaced = paired.withColumn("_spaces", F.lit(WHITESPACE))
    return spaced.withColumn("_entries", _entries(source_fields(paired), fields)).drop("_spaces")


def changed_fields(fields: Sequence[str] = MARC_TARGET) -> Column:
    """Changed fields of a row ``with_entries`` in target order, then known gaps on unchanged fields, as one array.

    The comparison stands in the plan once, as a function over the entries.
    """
    def compared(x: Column) -> Column:
        return F.struct(same(x["source_value"], x["target_value"]).alias("same"), x["pos"].alias("pos"),
                        x["source_value"].alias("source_value"), x["target_value"].alias("target_value"))

    kept = F.filter(F.transform(F.array_compact("_entries"), compared),
                    lambda x: ~x["same"] | (F.col("_gaps").isNotNull() & gap_note(_field_of(x["pos"], fields)).isNotNull()))
    return F.array_sort(kept)


def _explanation(x: Column) -> list[Column]:
    """Columns of one changed field with rule, status and note."""
    fields, pos = _compared_fields(MARC_TARGET), x["pos"]
    labels, details = zip(*[RULE_TEXTS.get(f, OTHER_RULE) for f in fields])
    field = _field_of(pos)
    note = F.when(F.col("_gaps").isNotNull(), gap_note(field))
    return [
        field.alias("source_field"), x["source_value"].alias("source_value"),
        F.coalesce(_by_position(details, pos), F.lit(OTHER_RULE[1])).alias("rule_applied"),
        x["target_value"].alias("target_value"),
        F.when(note.isNotNull(), "warning").otherwise("pass").alias("validation_status"),
        F.coalesce(note, F.lit("")).alias("notes"),
        F.coalesce(_by_position(labels, pos), F.lit(OTHER_RULE[0])).alias("rule_label"),
    ]


def preview_records(paired: DataFrame, gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """One record per expected row with its changed fields nested; nothing is grouped or shuffled for it."""
    fields = F.col("field_transformations")
    flagged = F.exists(fields, lambda f: f["validation_status"] != "pass")
    changed = with_entries(with_gaps(paired, gaps)).withColumn("_changed", changed_fields())
    explained = F.transform(F.col("_changed"), lambda x: F.struct(*_explanation(x)))
    return changed.withColumn("field_transformations", explained).select(
        _record_id(), F.col("t_PRODUCT").alias("matnr"), F.col("s_WERKS").alias("ecc_plant"), F.col("t_WERKS").alias("s4_plant"),
        F.when(flagged, "warning").otherwise("success").alias("overall_status"),
        fields,
    )


def _record_id() -> Column:
    return F.concat_ws("-", "t_PRODUCT", "t_WERKS").alias("record_id")


def preview_facts(paired: DataFrame, gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """One row per changed field, and one with a NULL field per record.

    The fields of a record that differ as text, a few of each record, are dealt out as rows and meet the one
    comparison of the plan there. An outer explode: for an inner one the optimizer would infer a filter on the
    array and copy its whole defining expression into it.
    """
    record = F.expr(f"array(named_struct('pos', -1, 'source_value', {NO_TEXT}, 'target_value', {NO_TEXT}))")
    rows = with_entries(with_gaps(paired, gaps)).select(_record_id(), "_gaps", "_entries").select(
        "record_id", "_gaps", F.explode_outer(F.concat(record, F.array_compact("_entries"))).alias("x"))
    noted = F.col("_gaps").isNotNull() & gap_note(_field_of(F.col("x.pos"))).isNotNull()
    kept = rows.filter((F.col("x.pos") < 0) | noted | ~same(F.col("x.source_value"), F.col("x.target_value")))
    return kept.select("record_id", *_explanation(F.col("x")))


def preview_changes(paired: DataFrame, gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """One row per changed field, and per known gap on an unchanged one."""
    return preview_facts(paired, gaps).filter(F.col("source_field").isNotNull())


def rows_with_gaps(source: DataFrame, gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """Source rows of the materials that known gaps name: all that the records with gaps are made of."""
    table = gaps if isinstance(gaps, DataFrame) else gap_table(source.sparkSession, gaps)
    named = table.select(F.col("material").alias("_named")).distinct()
    return source.join(named, F.col("MATNR") == F.col("_named"), "left_semi")


def known_gaps(paired: DataFrame, gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """The changes that known gaps are noted on; rows paired from ``rows_with_gaps`` have them all."""
    return preview_changes(paired, gaps).filter(F.col("validation_status") == "warning")


def rule_counts(changes: DataFrame) -> DataFrame:
    """How often each rule label applied, most frequent first."""
    return changes.groupBy("rule_label").agg(F.count(F.lit(1)).alias("applied")).orderBy(F.desc("applied"), "rule_label")


# --------------------------------------------------------------------------- #
# Report: rule counts, totals and reasons in one pass
# --------------------------------------------------------------------------- #

def preview_report(paired: DataFrame, unmapped: DataFrame, source: DataFrame,
                   gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """(section, label, rows, warnings): changes by rule, unmapped rows by reason, records and source rows.

    A NULL label is the section's total. Records are read once: their changed fields and their own rows come
    out of the same explode, are counted by label, and grouping sets over those few counts give the totals.
    """
    none = F.lit(None).cast("string")
    changed = F.col("source_field").isNotNull()
    facts = preview_facts(paired, gaps).select(
        F.when(changed, "change").otherwise("record").alias("section"), F.when(changed, F.col("rule_label")).alias("label"),
        (changed & (F.col("validation_status") != "pass")).alias("warned"))
    lost = unmapped.select(F.lit("unmapped").alias("section"), F.col("reason").alias("label"), F.lit(False).alias("warned"))
    scanned = source.select(F.lit("source").alias("section"), none.alias("label"), F.lit(False).alias("warned"))
    counted = facts.unionByName(lost).unionByName(scanned).groupBy("section", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("warned").alias("warnings"))
    section, label = F.col("section"), F.col("label")
    sets = counted.groupingSets([[section, label], [section]], section, label).agg(
        F.sum("rows").alias("rows"), F.sum("warnings").alias("warnings"), F.grouping("label").alias("whole"))
    return sets.filter((F.col("whole") == 1) | label.isNotNull()).drop("whole")


def report_rule_counts(report: DataFrame) -> DataFrame:
    rules = report.filter("section = 'change' AND label IS NOT NULL")
    return rules.select(F.col("label").alias("rule_label"), F.col("rows").alias("applied")).orderBy(F.desc("applied"), "rule_label")


def report_reasons(report: DataFrame) -> DataFrame:
    reasons = report.filter("section = 'unmapped' AND label IS NOT NULL")
    return reasons.select(F.col("label").alias("reason"), F.col("rows").alias("source_rows"))


def preview_totals(report: DataFrame) -> DataFrame:
    """Passes, warnings and success rate over all changed fields, records and source rows."""
    whole = report.filter(F.col("label").isNull())

    def total(section: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("section") == section, F.col(column))), F.lit(0).cast("bigint"))

    sums = whole.agg(total("record", "rows").alias("records"), total("source", "rows").alias("source_rows"),
                     total("change", "rows").alias("total"), total("change", "warnings").alias("warnings"))
    passes = F.col("total") - F.col("warnings")
    rate = F.concat(F.format_string("%.1f", round_binary(F.lit(100) * passes / F.col("total"), 1)), F.lit("%"))
    return sums.select(
        F.col("records").alias("preview_record_count"),
        F.col("source_rows").alias("ecc_rows_in"),
        passes.alias("success_count"),
        F.col("total").alias("total_transformations"),
        F.when(F.col("total") > 0, rate).otherwise("n/a").alias("success_rate"),
        F.lit(len(MARC_TARGET) - 1).cast("bigint").alias("total_fields_per_record"),
    )


# --------------------------------------------------------------------------- #
# Preview table rows
# --------------------------------------------------------------------------- #

def preview_pairs(columns: Sequence[str]) -> Column:
    """Source and target value of the pair fields, as a map of structs."""
    pairs = []
    for f in PAIR_FIELDS:
        ecc, s4 = _source(f, columns), _target(f)
        pairs += [F.lit(f), F.struct(ecc.alias("ecc"), s4.alias("s4"), (~same(ecc, s4)).alias("changed"),
                                     gap_note(f).alias("note"))]
    return F.create_map(*pairs)


def material_facts(mara: DataFrame, marm: DataFrame) -> DataFrame:
    """Type and unit of each material (last duplicate wins) and its first EA denominator."""
    last = last_per_key(mara.withColumn("_key", null_safe_key(F.col("MATNR"))), "_key", ["MTART", "MEINS", "LVORM"])
    ea = (
        marm.filter(F.col("MEINH") == "EA").groupBy(null_safe_key(F.col("MATNR")).alias("_key"))
        .agg(F.min_by(F.struct("UMREN"), ROW_ID).alias("_ea"))
    )
    return last.join(ea, "_key", "left").withColumn("_in_mara", F.lit(True))


def conversion() -> Column:
    """Lot size factor: the EA denominator for FERT in CS, 1 where there is none to read."""
    by_case = (F.col("MTART") == "FERT") & (F.col("MEINS") == "CS") & F.col("_ea").isNotNull()
    factor = F.when(F.col("_ea.UMREN").isNull(), F.lit(float("nan"))).otherwise(
        F.coalesce(float_value(F.col("_ea.UMREN")), F.lit(1.0)))
    return F.when(by_case, factor).otherwise(F.lit(1.0))


def summary_text(fields: Column) -> Column:
    """``Plant a→b; FIELD x→y; ...`` over the changed fields of the summary: the pair fields and the lot size."""
    told = F.filter(fields, lambda f: ~f["source_value"].eqNullSafe(f["target_value"]))
    words = F.transform(told, lambda f: F.concat(
        _field_of(f["pos"], SUMMARY_FIELDS), F.lit(" "), F.coalesce(f["source_value"], F.lit("blank")), F.lit("→"),
        F.coalesce(f["target_value"], F.lit("blank"))))
    plants = F.concat(F.lit("Plant "), F.col("s_WERKS"), F.lit("→"), F.col("t_WERKS"))
    return F.array_join(F.concat(F.array(plants), words), "; ")


def preview_rows(paired: DataFrame, mara: DataFrame, marm: DataFrame,
                 gaps: DataFrame | Sequence[Gap] = KNOWN_GAPS) -> DataFrame:
    """The preview table: one row per expected row with pairs, conversion and summary."""
    columns = source_fields(paired)
    facts = material_facts(mara, marm)
    noted_rows = with_entries(with_gaps(paired, gaps), SUMMARY_FIELDS).withColumn("_key", null_safe_key(F.col("t_PRODUCT")))
    rows = noted_rows.join(own_exchange(facts, "_key"), "_key", "left")
    noted = F.coalesce(*[gap_note(f) for f in PAIR_FIELDS]).isNotNull()
    # the row summary tells differences of the summary fields only, so only those are compared
    return rows.select(
        _record_id(),
        F.col("t_PRODUCT").alias("matnr"),
        F.col("MTART").alias("type"),
        F.col("s_WERKS").alias("ecc_plant"),
        F.col("t_WERKS").alias("s4_plant"),
        preview_pairs(columns).alias("pairs"),
        conversion().alias("conversion"),
        _source("LOSGR", columns).alias("ecc_losgr"),
        _target("LOSGR").alias("s4_losgr"),
        summary_text(changed_fields(SUMMARY_FIELDS)).alias("rules"),
        F.when(noted, "warning").otherwise("success").alias("status"),
    )


def losgr_check(rows: DataFrame) -> DataFrame:
    """Recomputed lot size of preview rows against the target's, at six decimals."""
    def rounded(x: Column) -> Column:
        return F.when(F.isnan(x), x).otherwise(F.format_string("%.6f", x).try_cast("double"))

    def number(c: Column) -> Column:
        return F.coalesce(num(c), F.lit(float("nan")))

    calc = F.when(F.col("ecc_losgr").isNotNull(), rounded(number(F.col("ecc_losgr")) * F.col("conversion")))
    base = rows.withColumn("calc_losgr", calc)
    mine, theirs = F.coalesce(F.col("calc_losgr"), F.lit(0.0)), rounded(
        F.when(F.col("s4_losgr").isNull(), F.lit(0.0)).otherwise(number(F.col("s4_losgr"))))
    return base.select(
        "record_id", "conversion", "ecc_losgr", "calc_losgr", "s4_losgr",
        ((mine == theirs) & ~F.isnan(mine) & ~F.isnan(theirs)).alias("matches"),
        (~fmt_num(F.col("calc_losgr")).eqNullSafe(F.col("ecc_losgr"))).alias("losgr_changed"),
    )


# --------------------------------------------------------------------------- #
# Source rows that produced nothing
# --------------------------------------------------------------------------- #

def unproduced_rows(source: DataFrame, produced: DataFrame) -> DataFrame:
    """Source rows whose (material, plant) no expected row came from.

    ``produced``: paired rows, or just the keys of the expected rows (``expected_plants``), which say as much.
    """
    keys = ("s_MATNR", "s_WERKS") if "s_MATNR" in produced.columns else ("PRODUCT", "_source")
    produced = produced.select(F.col(keys[0]).alias("MATNR"), F.col(keys[1]).alias("WERKS")).distinct()
    return source.join(own_exchange(produced, "MATNR", "WERKS"), ["MATNR", "WERKS"], "left_anti")


def preview_unmapped(source: DataFrame, produced: DataFrame, mara: DataFrame) -> DataFrame:
    """Unproduced source rows with the first reason that applies."""
    facts = last_per_key(mara.withColumn("_key", null_safe_key(F.col("MATNR"))), "_key",
                         ["MTART", F.col("LVORM").alias("_mara_lvorm")]).withColumn("_in_mara", F.lit(True))
    rows = unproduced_rows(source.select("MATNR", "WERKS", "LVORM"), produced)
    ruled = F.coalesce(F.col("WERKS").isin(*[r.source for r in ROUTES]), F.lit(False))
    reason = (
        F.when(~ruled, F.concat(F.lit("Plant "), F.coalesce(F.col("WERKS"), F.lit("nan")),
                                F.lit(" has no transformation rule")))
        .when(F.col("_in_mara").isNull(), "Material not found in MARA extract")
        .when(F.col("MTART") == "NVAL", "Material type NVAL is excluded")
        .when(blank_to_null(F.col("_mara_lvorm")).isNotNull(), "Material flagged for deletion in MARA")
        .when(blank_to_null(F.col("LVORM")).isNotNull(), "Plant-level deletion flag set")
        .otherwise("Filtered out by engine rules")
    )
    return rows.withColumn("_key", null_safe_key(F.col("MATNR"))).join(own_exchange(facts, "_key"), "_key", "left").select(
        "MATNR", F.col("WERKS").alias("ecc_plant"), reason.alias("reason"))


def reason_counts(unmapped: DataFrame) -> DataFrame:
    return unmapped.groupBy("reason").agg(F.count(F.lit(1)).alias("source_rows"))


# --------------------------------------------------------------------------- #
# Requested materials
# --------------------------------------------------------------------------- #

def requested_materials(requested: DataFrame) -> DataFrame:
    """Material numbers as typed -> distinct comparison keys, blanks dropped."""
    return requested.select(strip_zeros(blank_to_null(F.col("MATNR"))).alias("material")).filter(
        F.col("material").isNotNull()).distinct()


def filter_materials(raw: DataFrame, requested: DataFrame, column: str = "MATNR") -> DataFrame:
    """Raw rows of the requested materials. The plain equi semi-join leaves it to adaptive
    execution to broadcast the list, by its measured size."""
    wanted = requested_materials(requested)
    keyed = raw.withColumn("material", material_key(F.col(f"`{column}`")))
    return keyed.join(wanted, "material", "left_semi").drop("material")


def requested_not_in_source(requested: DataFrame, source: DataFrame) -> DataFrame:
    """Requested materials the normalised source does not have."""
    present = source.select(F.col("MATNR").alias("material")).distinct()
    return requested_materials(requested).join(present, "material", "left_anti")


def head_rows(source: DataFrame, limit: int, order: str = ROW_ID) -> DataFrame:
    """First source rows in ingest order (top-k, not a full sort)."""
    return source.orderBy(order).limit(limit)


