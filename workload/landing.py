"""Queries of the landing-folder scans and sinks.

Each session writes extracts derived from the driver tables once to the shared folder, then the
queries scan them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.layouts import MARC_LABELS, NA_TOKENS, SOURCE_FAMILIES, TARGET_FAMILIES
from siteshift.plans.latest import validate_latest
from siteshift.plans.validate import validate_direct
from siteshift.session import new_folder
from siteshift.sources import scan
from workload.expected_sql import target_ctes
from workload.extracts import actual_table, raw_extracts, source_sql, with_sql
from workload.reconciliation import by_plant_rows, by_plant_sql, coverage_sql, direct_count_sql, flat, mandatory_sql, report_sql, type_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_WRITTEN: dict[tuple, str] = {}
CELLS = ["MATNR", "WERKS", "LVORM", "BESKZ", "SOBSL", "MMSTD", "LOSGR"]


def register(name: str, query, oracle: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = oracle


def written(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder of a landing set, written once per session."""
    slot = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if slot not in _WRITTEN:
        folder = new_folder(spark, "landing")
        write(spark, sf_dir, folder)
        _WRITTEN[slot] = folder
    return _WRITTEN[slot]


def _csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _write_families(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Two plant-data extracts with different columns, a valuation one, and two that match nothing."""
    raw = raw_extracts(spark, sf_dir)
    marc, mbew = raw["MARC"], raw["MBEW"]
    _csv(marc.filter("WERKS < '1028'").select(*CELLS), f"{folder}/S_MARC#FreeText - part1.csv")
    _csv(marc.filter("WERKS >= '1028'").select("WERKS", "MATNR", "AWSLS"), f"{folder}/S_MARC#FreeText - part2.CSV")
    _csv(mbew.select("MATNR", "BWKEY", "STPRS"), f"{folder}/S_MBEW#FreeText.csv")
    # valuation rows are worked out once: the two that match nothing are made of the written ones
    materials = spark.read.csv(f"{folder}/S_MBEW#FreeText.csv", header=True).select("MATNR")
    _csv(materials, f"{folder}/X_S_MARC#FreeText.csv")
    materials.write.text(f"{folder}/S_MARC#FreeText.txt")


def families(spark: SparkSession, sf_dir: str) -> str:
    return written(spark, sf_dir, "families", _write_families)


def _write_repeated_header(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Files that start with a header of repeated names. Rows are dealt to the files by hash."""
    rows = raw_extracts(spark, sf_dir)["MARC"].select(
        F.pmod(F.hash("MATNR", "WERKS"), F.lit(8)).alias("file"), F.lit(1).alias("at"),
        F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in ("MATNR", "WERKS", "LGPRO", "XCHPF", "DISMM")]).alias("line"))
    headers = rows.select("file").distinct().select(
        "file", F.lit(0).alias("at"), F.lit("Material,Plant,Batch management,Batch management,Batch management").alias("line"))
    lines = rows.unionByName(headers).repartition("file").sortWithinPartitions("file", "at")
    lines.select("file", "line").write.partitionBy("file").text(f"{folder}/repeated.csv")


def _write_missing_texts(spark: SparkSession, sf_dir: str, folder: str) -> None:
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS if t], F.lit("N.A."), F.lit("kept"))
    cell = F.element_at(tokens, (F.col("MATNR").cast("bigint") % 20 + 1).cast("int"))
    _csv(raw_extracts(spark, sf_dir)["MARA"].select("MATNR", cell.alias("STATE")), f"{folder}/missing.csv")


def _write_references(spark: SparkSession, sf_dir: str, folder: str) -> None:
    raw = raw_extracts(spark, sf_dir)
    mara = raw["MARA"].select("MATNR", "LVORM", "MTART", "MEINS", "PRDHA", F.lit("x").alias("unused"))
    _csv(mara.limit(0), f"{folder}/MARA/ECC/mara_ecc_combined_old.csv")
    _csv(mara.toDF("Material", "DF at client level", "Material Type", "Base Unit", "Product hierarchy", "Unused"),
         f"{folder}/MARA/ECC/MARA_ECC_combined.csv")
    _csv(raw["MARM"].select("MATNR", "MEINH", "UMREN").toDF("Material", "AUn", "Denominator"),
         f"{folder}/MARM/ECC/MARM_ECC_combined.csv")
    raw["EKGRP"].write.parquet(f"{folder}/EKGRP_UPDATED/ECC/EKGRP_UPDATED_ECC_combined.parquet")


def references(spark: SparkSession, sf_dir: str) -> str:
    return written(spark, sf_dir, "references", _write_references)


def _write_sorted(spark: SparkSession, sf_dir: str, folder: str) -> None:
    _csv(raw_extracts(spark, sf_dir)["MARC"].select(*CELLS).orderBy(*CELLS), f"{folder}/sorted.csv")


_FIRST = "S_MARC#FreeText - part1.csv"
_FIRST_SQL = f"SELECT {', '.join(CELLS)} FROM raw_marc WHERE WERKS < '1028'"
register("scan_extract", lambda spark, sf: scan.scan_extract(spark, f"{families(spark, sf)}/{_FIRST}"), source_sql(_FIRST_SQL))
register("scan_family_select",
         lambda spark, sf: (lambda folder: scan.union_extracts(
             spark, scan.select_family(spark, folder, TARGET_FAMILIES["MARC"])).select("MATNR", "WERKS"))(families(spark, sf)),
         source_sql("SELECT MATNR, WERKS FROM raw_marc"))
register("union_extracts",
         lambda spark, sf: scan.union_extracts(spark, scan.select_family(spark, families(spark, sf), TARGET_FAMILIES["MARC"])),
         source_sql(f"""{_FIRST_SQL.replace(' FROM', ', CAST(NULL AS VARCHAR) AS AWSLS FROM')}
           UNION ALL SELECT MATNR, WERKS, NULL, NULL, NULL, NULL, NULL, AWSLS FROM raw_marc WHERE WERKS >= '1028'"""))
register("extract_stats",
         lambda spark, sf: scan.extract_stats(spark, families(spark, sf), TARGET_FAMILIES, "S4"),
         source_sql("""SELECT 'MARC_S4' AS name, 'MARC' AS family, 'S4' AS source_type, CAST(2 AS BIGINT) AS source_files,
             (SELECT count(*) FROM raw_marc) AS row_count
           UNION ALL SELECT 'MBEW_S4', 'MBEW', 'S4', 1, (SELECT count(*) FROM raw_mbew)"""))
register("empty_family",
         lambda spark, sf: scan.extract_stats(spark, families(spark, sf), {"MBEW": TARGET_FAMILIES["MBEW"], "MARD": "S_MARD#"}, "S4")
         .select("family", "source_files", "row_count"),
         source_sql("""SELECT 'MBEW' AS family, CAST(1 AS BIGINT) AS source_files, (SELECT count(*) FROM raw_mbew) AS row_count
           UNION ALL SELECT 'MARD', 0, 0"""))


def _write_sources(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Source-side families; a material text with quoted line breaks, commas and quotes."""
    raw = raw_extracts(spark, sf_dir)
    note = F.concat(F.lit('first, "line"\n'), F.col("MATNR"), F.lit("\r\n last "))
    _csv(raw["MARC"].select("MATNR", "WERKS", note.alias("NOTE")), f"{folder}/MARC_DAP_1.csv")
    _csv(raw["MARC"].limit(0).select("MATNR", "WERKS"), f"{folder}/MARC_DAP_2.csv")
    _csv(raw["MBEW"].select("MATNR", "STPRS"), f"{folder}/MBEW_DAP.csv")


def _summary(side: str, landing_set, prefixes: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = new_folder(spark, "fetched")
        found = scan.fetch_summary(spark, landing_set(spark, sf_dir), root, prefixes, side)
        return found.withColumn("saved_path", F.replace("saved_path", F.lit(root), F.lit("")))

    return query


_sources = lambda spark, sf: written(spark, sf, "sources", _write_sources)
register("scan_quoted_breaks", lambda spark, sf: scan.scan_extract(spark, f"{_sources(spark, sf)}/MARC_DAP_1.csv"),
         source_sql("""SELECT MATNR, WERKS, 'first, "line"' || chr(10) || MATNR || chr(13) || chr(10) || ' last ' AS NOTE FROM raw_marc"""))
register("fetch_summary_source", _summary("ECC", _sources, SOURCE_FAMILIES),
         source_sql("""SELECT f || '_ECC' AS name, f AS family, 'ECC' AS source_type, n AS source_files, r AS row_count,
             '/' || f || '/ECC/' || f || '_ECC_combined.parquet' AS saved_path, CAST(3 AS BIGINT) AS total_files_fetched
           FROM (SELECT 'MARC' AS f, CAST(2 AS BIGINT) AS n, (SELECT count(*) FROM raw_marc) AS r
                 UNION ALL SELECT 'MBEW', 1, (SELECT count(*) FROM raw_mbew)) x"""))
register("fetch_summary_target", _summary("S4", families, {**TARGET_FAMILIES, "MARD": "S_MARD#FreeText"}),
         source_sql("""SELECT f || '_S4' AS name, f AS family, 'S4' AS source_type, n AS source_files, r AS row_count,
             '/' || f || '/S4/' || f || '_S4_combined.parquet' AS saved_path, CAST(3 AS BIGINT) AS total_files_fetched
           FROM (SELECT 'MARC' AS f, CAST(2 AS BIGINT) AS n, (SELECT count(*) FROM raw_marc) AS r
                 UNION ALL SELECT 'MBEW', 1, (SELECT count(*) FROM raw_mbew) UNION ALL SELECT 'MARD', 0, 0) x"""))
register("sink_combined",
         lambda spark, sf: spark.read.parquet(scan.fetch_families(
             spark, families(spark, sf), new_folder(spark, "combined"), TARGET_FAMILIES, "S4")["MARC"]),
         ORACLE["union_extracts"])
register("scan_dedup_header",
         lambda spark, sf: (lambda d: d.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_").replace(".", "_")) for c in d.columns]))(
             scan.scan_extract(spark, f"{written(spark, sf, 'repeated', _write_repeated_header)}/repeated.csv")),
         source_sql("""SELECT MATNR AS Material, WERKS AS Plant, LGPRO AS Batch_management, XCHPF AS Batch_management_1,
           DISMM AS Batch_management_2 FROM raw_marc"""))
register("scan_na_tokens",
         lambda spark, sf: scan.scan_extract(spark, f"{written(spark, sf, 'missing', _write_missing_texts)}/missing.csv"),
         source_sql("""SELECT MATNR, CASE CAST(MATNR AS BIGINT) % 20 WHEN 18 THEN 'N.A.' WHEN 19 THEN 'kept' END AS STATE FROM raw_mara"""))
register("latest_extract",
         lambda spark, sf: scan.scan_extract(spark, scan.latest_extract(
             spark, f"{references(spark, sf)}/MARA/ECC", "MARA_ECC_combined")).select(
                 F.col("Material").alias("MATNR"), F.col("`Material Type`").alias("MTART")),
         source_sql("SELECT MATNR, MTART FROM raw_mara"))
register("load_reference",
         lambda spark, sf: scan.load_reference(spark, references(spark, sf), "MARA", "MARA").drop("_row_id"),
         source_sql("SELECT MATNR, LVORM, MTART, MEINS, PRDHA FROM mara"))
register("load_reference_optional",
         lambda spark, sf: scan.load_tables(spark, references(spark, sf))["EKGRP"].drop("_row_id"),
         source_sql("SELECT MATNR, WERKS, EKGRP FROM ekgrp"))
register("preview_table",
         lambda spark, sf: scan.preview_table(scan.scan_extract(
             spark, f"{written(spark, sf, 'sorted', _write_sorted)}/sorted.csv", row_id=True), 50)[0],
         source_sql(f"SELECT {', '.join(CELLS)} FROM raw_marc ORDER BY {', '.join(f'{c} NULLS FIRST' for c in CELLS)} LIMIT 50"))
register("preview_table_counts",
         lambda spark, sf: scan.preview_table(scan.scan_extract(
             spark, f"{written(spark, sf, 'sorted', _write_sorted)}/sorted.csv", row_id=True), 50)[1],
         source_sql("SELECT count(*) AS total_rows, least(count(*), 50) AS preview_row_count FROM raw_marc"))


def _write_pair(spark: SparkSession, sf_dir: str, folder: str) -> None:
    _csv(raw_extracts(spark, sf_dir)["MARC"].select(*CELLS), f"{folder}/source.csv")
    actual_table(spark, sf_dir, "MARC").write.parquet(f"{folder}/target.parquet")


def _scan_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = written(spark, sf_dir, "pair", _write_pair)
    return flat(validate_direct("MARC", scan.scan_extract(spark, f"{folder}/source.csv"),
                                scan.scan_extract(spark, f"{folder}/target.parquet")))


register("scan_pair", _scan_pair, with_sql(target_ctes("MARC"), " UNION ALL ".join(
    f"SELECT * FROM ({q}) q{i}" for i, q in enumerate(
        [coverage_sql("MARC"), mandatory_sql("MARC"), type_sql("MARC"), direct_count_sql("raw_marc")]))))


# --- the latest files, validated ------------------------------------------------ #
def _write_latest(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Combined source and target files of both sheets, with an older one beside them, and the reference tables."""
    _write_references(spark, sf_dir, folder)
    raw = raw_extracts(spark, sf_dir)
    for sheet in ("MARC", "MBEW"):
        _csv(raw[sheet].limit(3).drop("_row_id"), f"{folder}/{sheet}/ECC/{sheet}_ECC_combined_old.csv")
        _csv(raw[sheet].drop("_row_id"), f"{folder}/{sheet}/ECC/{sheet}_ECC_combined.csv")
        _csv(actual_table(spark, sf_dir, sheet), f"{folder}/{sheet}/S4/{sheet}_S4_combined.csv")


def _latest(sheet: str, result):
    return lambda spark, sf: result(validate_latest(spark, written(spark, sf, "latest", _write_latest), sheet))


for _sheet in ("MARC", "MBEW"):
    register(f"validate_latest_{_sheet.lower()}", _latest(_sheet, lambda staged: flat(staged.rules())), report_sql(_sheet))
register("validate_latest_by_plant", _latest("MARC", lambda staged: by_plant_rows(staged.by_plant())), by_plant_sql("MARC"))


# --- tables under many headers, numbers of rows --------------------------------- #
_HEADERS = [
    CELLS,
    [{v: k for k, v in MARC_LABELS.items()}.get(c, c) for c in CELLS],
    [c.lower() for c in CELLS],
    ["UNUSED", *reversed(CELLS)],
]


def _write_headers(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Plant data dealt to extracts under technical names, labels, lower case, and another order with a further column."""
    rows = raw_extracts(spark, sf_dir)["MARC"].withColumn("UNUSED", F.lit("x"))
    for k, names in enumerate(_HEADERS):
        order = CELLS if k < 3 else _HEADERS[3]
        _csv(rows.filter(F.pmod(F.xxhash64("_row_id"), F.lit(len(_HEADERS))) == k).select(*order).toDF(*names), f"{folder}/extract{k}.csv")


def _extracts(spark: SparkSession, sf_dir: str) -> list[str]:
    folder = written(spark, sf_dir, "headers", _write_headers)
    return [f"{folder}/extract{k}.csv" for k in range(len(_HEADERS))]


register("union_normalized", lambda spark, sf: scan.union_normalized(spark, _extracts(spark, sf), "MARC").select(*CELLS),
         source_sql(f"SELECT {', '.join(CELLS)} FROM marc"))
register("ingest_numbers",
         lambda spark, sf: scan.union_extracts(spark, _extracts(spark, sf), row_id=True).agg(
             F.count(F.lit(1)).alias("n"), F.min("_row_id").alias("first"), F.max("_row_id").alias("last"),
             F.count_distinct("_row_id").alias("numbers")),
         source_sql("SELECT count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS numbers FROM raw_marc"))
