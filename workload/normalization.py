"""Queries of header resolution and value cleaning, over a labelled and damaged extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.layouts import REQUIRED
from siteshift.sources import normalize as n
from workload.extracts import clean_sql, raw_extracts, source_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, oracle: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = oracle


# Headers as an export shows them: labels in any case, padded, technical names in lower case.
LABELLED = {
    "MATNR": " Material", "WERKS": "PLANT", "LVORM": "DF at plant level ", "BESKZ": "procurement type",
    "SOBSL": "Special procurement", "SFCPF": "Prod.Sched.Profile", "MMSTA": "Plant-sp.matl status", "MMSTD": "Valid from",
    "XCHPF": "Batch management.1", "LOSGR": "Costing Lot Size", "DISMM": "dismm", "EISBE": "Safety Stock",
}
_SHOWN = ["MATNR", "WERKS", "LVORM", "BESKZ", "SOBSL", "SFCPF", "MMSTA", "MMSTD", "XCHPF", "LOSGR", "DISMM", "EISBE"]


def raw_marc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_extracts(spark, sf_dir)["MARC"].select(*_SHOWN)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_marc(spark, sf_dir).toDF(*[LABELLED[c] for c in _SHOWN])


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells padded with blanks and tabs, NULLs as blanks."""
    df = raw_marc(spark, sf_dir)
    return df.select(*[F.concat(F.lit(" \t"), F.coalesce(c, F.lit("")), F.lit("  ")).alias(c) for c in df.columns])


_RAW = ", ".join(_SHOWN)
_CLEAN = ", ".join(f"{clean_sql(c)} AS {c}" for c in _SHOWN)
register("clean_blank", lambda spark, sf: n.clean_blank(damaged(spark, sf)), source_sql(f"SELECT {_CLEAN} FROM raw_marc"))
register("header_trim",
         lambda spark, sf: n.trim_header(raw_marc(spark, sf).toDF(*[f" {c} " for c in _SHOWN])),
         source_sql(f"SELECT {_RAW} FROM raw_marc"))
register("rename_labels",
         lambda spark, sf: n.rename_labels(n.trim_header(labelled(spark, sf)), "MARC").withColumnRenamed("dismm", "DISMM"),
         source_sql(f"SELECT {_RAW} FROM raw_marc"))
register("rename_technical_case",
         lambda spark, sf: n.rename_technical_case(raw_marc(spark, sf).toDF(*[c.lower() for c in _SHOWN]), "MARC"),
         source_sql(f"SELECT {_RAW} FROM raw_marc"))
register("rename_aliases",
         lambda spark, sf: n.rename_aliases(raw_extracts(spark, sf)["MARA"].drop("_row_id").toDF(
             "Material", "Deletion Flag", "Mat. type", "BASE UNIT", "Product hierarchy"), "MARA"),
         source_sql("SELECT MATNR, LVORM, MTART, MEINS, PRDHA FROM raw_mara"))
register("dedup_columns",
         lambda spark, sf: n.dedup_columns(raw_marc(spark, sf).select("MATNR", "WERKS", "BESKZ", "SOBSL").toDF(
             "MATNR", "WERKS", "BESKZ", "BESKZ")),
         source_sql("SELECT MATNR, WERKS, BESKZ FROM raw_marc"))
register("add_missing_columns",
         lambda spark, sf: n.add_missing_columns(raw_extracts(spark, sf)["MARM"].select("MATNR", "MEINH"), "MARM"),
         source_sql("SELECT MATNR, MEINH, CAST(NULL AS VARCHAR) AS UMREN FROM raw_marm"))
register("strip_key_zeros",
         lambda spark, sf: n.strip_key_zeros(raw_extracts(spark, sf)["MARM"].select("MATNR", "MEINH")),
         source_sql("SELECT regexp_replace(MATNR, '^0+', '') AS MATNR, MEINH FROM raw_marm"))
register("normalize_extract",
         lambda spark, sf: n.normalize_extract(labelled(spark, sf), "MARC", required_only=True),
         source_sql("SELECT {} FROM marc".format(", ".join(
             c if c in _SHOWN else f"CAST(NULL AS VARCHAR) AS {c}" for c in REQUIRED["MARC"]))))
