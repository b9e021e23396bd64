"""Queries of the transformation preview, against SQL written from the rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.layouts import MARC_TARGET, OTHER_RULE, PAIR_FIELDS, REQUIRED, RULE_TEXTS
from siteshift.operators import explain
from siteshift.plans.preview import paired_targets
from siteshift.plans.transform import keyed_targets
from workload.expected_sql import target_ctes
from workload.extracts import expected_keys, read, source_tables, with_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Known divergences for the derived materials: one on a changed field, others on unchanged ones.
GAPS = (
    ("12", "US30", "LGPRO", "seen blank"),
    ("14", "US29", "SOBSL", "seen 64"),
    ("15", "US29", "LGFSB", "seen blank"),
    ("16", "CA02", "DISPO", "seen other"),
    ("40", "US29", "SOBSL", "seen 64"),
    ("44", "US26", "MMSTA", "seen PW"),
)


def register(name: str, query, oracle: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = oracle


def paired(spark: SparkSession, sf_dir: str, fields=MARC_TARGET) -> DataFrame:
    return paired_targets(source_tables(spark, sf_dir), fields)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.preview_records(paired(spark, sf_dir), GAPS)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = source_tables(spark, sf_dir)
    return explain.preview_rows(paired(spark, sf_dir, explain.SUMMARY_FIELDS), tables["MARA"], tables["MARM"], GAPS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.preview_changes(paired(spark, sf_dir), GAPS)


def gap_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = source_tables(spark, sf_dir)
    tables["MARC"] = explain.rows_with_gaps(tables["MARC"], GAPS)
    return explain.known_gaps(explain.pair_with_source(keyed_targets("MARC", tables), tables["MARC"]), GAPS)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.preview_report(paired(spark, sf_dir), unmapped(spark, sf_dir), source_tables(spark, sf_dir)["MARC"], GAPS)


def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = source_tables(spark, sf_dir)
    return explain.preview_unmapped(tables["MARC"], expected_keys(spark, sf_dir, "MARC"), tables["MARA"])


# --------------------------------------------------------------------------- #
# SQL side
# --------------------------------------------------------------------------- #

def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_REVERSE = """CASE WHEN {w} IN ('US30', 'US27') THEN '1021' WHEN {w} IN ('US31', 'US28') THEN '1028'
  WHEN {w} IN ('US33', 'US32') THEN '1030' WHEN {w} = 'US29' THEN '1025' WHEN {w} = 'US26' THEN '1000' WHEN {w} = 'CA02' THEN '1029' END"""
_PAIRED = f"""
SELECT row_number() OVER () AS pair_no, {', '.join(f't.{c} AS t_{c}' for c in MARC_TARGET)}, s.WERKS AS s_WERKS,
       {', '.join(f's.{c} AS s_{c}' for c in MARC_TARGET if c in REQUIRED['MARC'] and c != 'WERKS')}
FROM expected t JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY MATNR, WERKS ORDER BY _row_id) AS k FROM marc) n WHERE k = 1) s
ON t.PRODUCT = s.MATNR AND {_REVERSE.format(w='t.WERKS')} = s.WERKS
"""
_SAME = ("(({a}) IS NOT DISTINCT FROM ({b}) OR coalesce(TRY_CAST(({a}) AS DOUBLE) = TRY_CAST(({b}) AS DOUBLE), false))")


def _values(field: str) -> tuple[str, str]:
    source = f"nullif(trim(s_{field}), '')" if field in REQUIRED["MARC"] else "CAST(NULL AS VARCHAR)"
    return source, f"nullif(trim(t_{field}), '')"


def _note(field: str) -> str:
    hits = "".join(f" WHEN t_PRODUCT = {_quote(m)} AND t_WERKS = {_quote(p)} THEN {_quote(n)}"
                   for m, p, f, n in GAPS if f == field)
    return f"CASE{hits} END" if hits else "CAST(NULL AS VARCHAR)"


def _entry_sql(pos: int, field: str) -> str:
    a, b = _values(field)
    label, detail = RULE_TEXTS.get(field, OTHER_RULE)
    return (f"{{'pos': {pos}, 'source_field': '{field}', 'source_value': {a}, 'target_value': {b}, 'note': {_note(field)}, "
            f"'gap': {_gap_position(field)}, 'rule_applied': {_quote(detail)}, 'rule_label': {_quote(label)}}}")


def changes_sql() -> str:
    """Changed or flagged fields of every pair; flagged unchanged ones come after all changes."""
    entries = ", ".join(_entry_sql(i, f) for i, f in enumerate(f for f in MARC_TARGET if f != "PRODUCT"))
    same = _SAME.format(a="u.source_value", b="u.target_value")
    return f"""SELECT pair_no, record_id, CASE WHEN {same} THEN 1000 + u.gap ELSE u.pos END AS pos, u.source_field AS source_field,
  u.source_value AS source_value, u.rule_applied AS rule_applied, u.target_value AS target_value,
  CASE WHEN u.note IS NULL THEN 'pass' ELSE 'warning' END AS validation_status, coalesce(u.note, '') AS notes,
  u.rule_label AS rule_label
FROM (SELECT pair_no, t_PRODUCT || '-' || t_WERKS AS record_id, unnest([{entries}]) AS u FROM paired) e
WHERE NOT {same} OR u.note IS NOT NULL"""


def _gap_position(field: str) -> str:
    hits = "".join(f" WHEN t_PRODUCT = {_quote(m)} AND t_WERKS = {_quote(p)} THEN {i}"
                   for i, (m, p, f, _) in enumerate(GAPS) if f == field)
    return f"CASE{hits} END" if hits else "0"


_FACTS = """
SELECT m.MATNR, m.MTART, m.MEINS, m.LVORM, ea.um, ea.MATNR IS NOT NULL AS has_ea
FROM (SELECT *, row_number() OVER (PARTITION BY MATNR ORDER BY _row_id DESC) AS k FROM mara) m
LEFT JOIN ea ON m.MATNR = ea.MATNR WHERE k = 1
"""
_CONV = ("CASE WHEN f.MTART = 'FERT' AND f.MEINS = 'CS' AND f.has_ea THEN coalesce(TRY_CAST(f.um AS DOUBLE), 1.0) ELSE 1.0 END")


def blocks() -> list[tuple[str, str]]:
    return target_ctes("MARC") + [
        ("paired", _PAIRED),
        ("changes", changes_sql()),
        ("facts", _FACTS),
        ("unmapped", f"""SELECT s.MATNR, s.WERKS AS ecc_plant, CASE
            WHEN s.WERKS NOT IN ('1021', '1028', '1030', '1025', '1000', '1029')
              THEN 'Plant ' || s.WERKS || ' has no transformation rule'
            WHEN f.MATNR IS NULL THEN 'Material not found in MARA extract'
            WHEN f.MTART = 'NVAL' THEN 'Material type NVAL is excluded'
            WHEN f.LVORM IS NOT NULL THEN 'Material flagged for deletion in MARA'
            WHEN s.LVORM IS NOT NULL THEN 'Plant-level deletion flag set' ELSE 'Filtered out by engine rules' END AS reason
          FROM marc s LEFT JOIN facts f ON s.MATNR = f.MATNR
          WHERE NOT EXISTS (SELECT 1 FROM paired p WHERE p.t_PRODUCT = s.MATNR AND p.s_WERKS = s.WERKS)"""),
    ]


def sql(final: str) -> str:
    return with_sql(blocks(), final)


# --------------------------------------------------------------------------- #
# Queries
# --------------------------------------------------------------------------- #
register("join_expected_source",
         lambda spark, sf: paired(spark, sf).select(
             F.col("t_PRODUCT").alias("PRODUCT"), F.col("t_WERKS").alias("WERKS"), F.col("s_WERKS").alias("source_plant"),
             F.col("s.BESKZ").alias("source_beskz")),
         sql("SELECT t_PRODUCT AS PRODUCT, t_WERKS AS WERKS, s_WERKS AS source_plant, s_BESKZ AS source_beskz FROM paired"))
register("anti_unmapped",
         lambda spark, sf: explain.unproduced_rows(source_tables(spark, sf)["MARC"].select("MATNR", "WERKS"), expected_keys(spark, sf, "MARC")),
         sql("SELECT MATNR, ecc_plant AS WERKS FROM unmapped"))
register("preview_changes", changes, sql(
    "SELECT record_id, source_field, source_value, rule_applied, target_value, validation_status, notes, rule_label FROM changes"))
register("preview_known_gaps",
         lambda spark, sf: gap_changes(spark, sf).select("record_id", "source_field", "source_value", "target_value", "notes"),
         sql("SELECT record_id, source_field, source_value, target_value, notes FROM changes WHERE validation_status = 'warning'"))
register("preview_records",
         lambda spark, sf: records(spark, sf).select(
             "record_id", "matnr", "ecc_plant", "s4_plant", "overall_status",
             F.array_join(F.transform("field_transformations", lambda f: f["source_field"]), ",").alias("fields")),
         sql("""SELECT t_PRODUCT || '-' || t_WERKS AS record_id, t_PRODUCT AS matnr, s_WERKS AS ecc_plant, t_WERKS AS s4_plant,
                  CASE WHEN bool_or(validation_status = 'warning') THEN 'warning' ELSE 'success' END AS overall_status,
                  string_agg(source_field, ',' ORDER BY pos) AS fields
                FROM paired p JOIN changes c ON c.pair_no = p.pair_no GROUP BY p.pair_no, t_PRODUCT, t_WERKS, s_WERKS"""))
register("rule_counts", lambda spark, sf: explain.rule_counts(changes(spark, sf)), sql(
    "SELECT rule_label, count(*) AS applied FROM changes GROUP BY rule_label ORDER BY applied DESC, rule_label"))
register("preview_totals",
         lambda spark, sf: explain.preview_totals(report(spark, sf)),
         sql("""SELECT (SELECT count(*) FROM paired) AS preview_record_count, (SELECT count(*) FROM marc) AS ecc_rows_in,
                  count(*) FILTER (WHERE validation_status = 'pass') AS success_count, count(*) AS total_transformations,
                  printf('%.1f', 100.0 * count(*) FILTER (WHERE validation_status = 'pass') / count(*)) || '%' AS success_rate,
                  CAST(145 AS BIGINT) AS total_fields_per_record FROM changes"""))

register("preview_report", report,
         sql("""SELECT 'change' AS section, rule_label AS label, count(*) AS rows, count(*) FILTER (WHERE validation_status <> 'pass') AS warnings
                FROM changes GROUP BY rule_label
                UNION ALL SELECT 'change', NULL, count(*), count(*) FILTER (WHERE validation_status <> 'pass') FROM changes
                UNION ALL SELECT 'record', NULL, count(*), 0 FROM paired UNION ALL SELECT 'source', NULL, count(*), 0 FROM marc
                UNION ALL SELECT 'unmapped', reason, count(*), 0 FROM unmapped GROUP BY reason
                UNION ALL SELECT 'unmapped', NULL, count(*), 0 FROM unmapped"""))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.col("pairs")
    return rows(spark, sf_dir).select(
        "record_id", *[pair[f][part].alias(f"{f.lower()}_{part}") for f in PAIR_FIELDS for part in ("ecc", "s4", "changed", "note")])


def _pairs_sql() -> str:
    columns = []
    for f in PAIR_FIELDS:
        a, b = _values(f)
        columns += [f"{a} AS {f.lower()}_ecc", f"{b} AS {f.lower()}_s4", f"NOT {_SAME.format(a=a, b=b)} AS {f.lower()}_changed",
                    f"{_note(f)} AS {f.lower()}_note"]
    return f"SELECT t_PRODUCT || '-' || t_WERKS AS record_id, {', '.join(columns)} FROM paired"


register("preview_pairs", _pairs, sql(_pairs_sql()))
register("preview_conversion", lambda spark, sf: rows(spark, sf).select("record_id", "type", "conversion"), sql(
    f"""SELECT t_PRODUCT || '-' || t_WERKS AS record_id, f.MTART AS type, {_CONV} AS conversion
        FROM paired LEFT JOIN facts f ON f.MATNR = t_PRODUCT"""))
_TOLD = ", ".join(_quote(f) for f in explain.SUMMARY_FIELDS)
register("preview_summary_text", lambda spark, sf: rows(spark, sf).select("record_id", "rules"), sql(
    f"""SELECT r.record_id, 'Plant ' || s_WERKS || '→' || t_WERKS || coalesce('; ' || words, '') AS rules
        FROM (SELECT *, t_PRODUCT || '-' || t_WERKS AS record_id FROM paired) r LEFT JOIN (
          SELECT pair_no, string_agg(source_field || ' ' || coalesce(source_value, 'blank') || '→' || coalesce(target_value, 'blank'),
                                       '; ' ORDER BY pos) AS words
          FROM changes WHERE source_field IN ({_TOLD}) AND source_value IS DISTINCT FROM target_value GROUP BY pair_no) w
        ON r.pair_no = w.pair_no"""))
_FLAGGED = " OR ".join(f"({_note(f)}) IS NOT NULL" for f in PAIR_FIELDS)
register("preview_record_status", lambda spark, sf: rows(spark, sf).select("record_id", "status"), sql(
    f"""SELECT t_PRODUCT || '-' || t_WERKS AS record_id, CASE WHEN {_FLAGGED} THEN 'warning' ELSE 'success' END AS status FROM paired"""))
register("preview_losgr_check", lambda spark, sf: explain.losgr_check(rows(spark, sf)), sql(
    f"""SELECT record_id, conversion, ecc_losgr, calc_losgr, s4_losgr,
          coalesce(calc_losgr, 0) = round(coalesce(CAST(s4_losgr AS DOUBLE), 0), 6) AS matches,
          rtrim(rtrim(printf('%.6f', calc_losgr), '0'), '.') IS DISTINCT FROM ecc_losgr AS losgr_changed
        FROM (SELECT *, round(CAST(ecc_losgr AS DOUBLE) * conversion, 6) AS calc_losgr FROM (
          SELECT t_PRODUCT || '-' || t_WERKS AS record_id, {_CONV} AS conversion, nullif(trim(s_LOSGR), '') AS ecc_losgr,
                 nullif(trim(t_LOSGR), '') AS s4_losgr
          FROM paired LEFT JOIN facts f ON f.MATNR = t_PRODUCT) c) d"""))
register("preview_unmapped", unmapped, sql("SELECT * FROM unmapped"))
register("preview_reason_counts", lambda spark, sf: explain.reason_counts(unmapped(spark, sf)),
         sql("SELECT reason, count(*) AS source_rows FROM unmapped GROUP BY reason"))


# --- requested materials ------------------------------------------------------- #
REQUESTED = """
SELECT CASE o_custkey % 4 WHEN 0 THEN ' 000' || CAST(o_custkey AS STRING) WHEN 1 THEN CAST(o_custkey * 3 AS STRING)
            WHEN 2 THEN '' ELSE CAST(o_custkey AS STRING) || ' ' END AS MATNR FROM {orders}
"""
_WANTED = ("requested", "SELECT DISTINCT regexp_replace(trim(MATNR), '^0+', '') AS material FROM ("
           + REQUESTED.format(orders="orders") + ") r WHERE trim(MATNR) <> ''")


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTED, orders=read(spark, sf_dir, "orders"))


register("filter_materials",
         lambda spark, sf: explain.filter_materials(source_tables(spark, sf)["MARC"], requested(spark, sf)).select(
             "MATNR", "WERKS", "BESKZ"),
         with_sql(target_ctes("MARC") + [_WANTED],
                  "SELECT MATNR, WERKS, BESKZ FROM marc WHERE MATNR IN (SELECT material FROM requested)"))
register("anti_requested",
         lambda spark, sf: explain.requested_not_in_source(requested(spark, sf), source_tables(spark, sf)["MARC"]),
         with_sql(target_ctes("MARC") + [_WANTED],
                  "SELECT material FROM requested WHERE material NOT IN (SELECT MATNR FROM marc WHERE MATNR IS NOT NULL)"))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteshift.plans.preview import transformation_preview

    parts = transformation_preview(source_tables(spark, sf_dir), requested=requested(spark, sf_dir), gaps=GAPS)
    return parts.totals


_SUBSET = [(name, body) for name, body in blocks()]
_SUBSET = [(("marc_all", body) if name == "marc" else (name, body)) for name, body in _SUBSET]
_at = [name for name, _ in _SUBSET].index("marc_all") + 1
_SUBSET[_at:_at] = [_WANTED, ("marc", "SELECT * FROM marc_all WHERE MATNR IN (SELECT material FROM requested)")]
register("transformation_preview", _preview, with_sql(_SUBSET, ORACLE["preview_totals"].rsplit("\nSELECT (SELECT", 1)[-1].join(
    ["SELECT (SELECT", ""])))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested material: found or not, next to the rows available and used."""
    from siteshift.plans.preview import transformation_preview

    parts = transformation_preview(source_tables(spark, sf_dir), requested=requested(spark, sf_dir), gaps=GAPS)
    lost = parts.not_found.withColumn("_lost", F.lit(True))
    listed = parts.requested.join(lost, "material", "left").select("material", F.col("_lost").isNull().alias("found"), F.lit(1).alias("one"))
    counts = parts.available.withColumn("one", F.lit(1)).join(parts.used.withColumn("one", F.lit(1)), "one")
    return listed.join(F.broadcast(counts), "one").drop("one")  # counts is one row


register("preview_requests", _requests,
         with_sql(target_ctes("MARC") + [_WANTED],
                  """SELECT material, material IN (SELECT MATNR FROM marc WHERE MATNR IS NOT NULL) AS found,
                       (SELECT count(*) FROM marc) AS total_rows_available,
                       (SELECT count(*) FROM marc WHERE MATNR IN (SELECT material FROM requested)) AS ecc_rows_in
                     FROM requested"""))
