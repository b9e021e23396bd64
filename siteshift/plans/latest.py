"""Validation of the latest landed files, end to end, over tables that are written once.

The expected table is transformed once and written; the actual table is read once and written, and the counts of the
field rules are observed on its way. The rules then read written tables and one row of counts, so a report plans no
transformation and scans no delimited file again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteshift.mapping import DEFAULT_MAPPING, FieldMapping
from siteshift.operators import reconcile as r
from siteshift.plans import validate as v
from siteshift.plans.transform import transform_table
from siteshift.session import new_folder
from siteshift.sources import scan
from siteshift.sources.normalize import normalize_extract


def written(df: DataFrame, what: str, observed: Sequence[Column] = ()) -> tuple[DataFrame, dict[str, int]]:
    """df as a table of the shared folder, with aggregates observed while it is written.

    The observed aggregates stand right below the write: each partition counts once, however often a task is repeated.
    """
    spark = df.sparkSession
    folder, seen = new_folder(spark, what), Observation()
    (df.observe(seen, *observed) if observed else df).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), seen.get if observed else {}


@dataclass(frozen=True)
class Staged:
    """One sheet's written expected and actual tables, and the field counts of the actual one."""

    sheet: str
    mapping: Sequence[FieldMapping]
    expected: DataFrame
    actual: DataFrame
    quality: DataFrame
    source_rows: int

    def rules(self, **options) -> DataFrame:
        return v.validate_expected_actual(self.sheet, self.expected, self.actual, self.mapping, quality=self.quality, **options)

    def plant(self, plant: str, **options) -> DataFrame:
        return v.validate_plant(self.sheet, self.expected, self.actual, plant, self.mapping, **options)

    def by_plant(self, **options) -> DataFrame:
        return v.validate_by_plant(self.sheet, self.expected, self.actual, self.mapping, **options)

    def report(self, **options) -> DataFrame:
        return v.report_row(self.sheet, self.rules(**options), F.lit(self.source_rows).cast("bigint"), self.mapping)


def staged(sheet: str, source: DataFrame, expected: DataFrame, actual: DataFrame, mapping: Sequence[FieldMapping] | None = None) -> Staged:
    mapping = DEFAULT_MAPPING[sheet] if mapping is None else mapping
    expected, _ = written(expected, f"expected-{sheet}")
    actual, counts = written(actual, f"actual-{sheet}", r.quality_counts(sheet, actual.columns, mapping))
    kinds = ", ".join(f"{name} bigint" for name in counts)
    return Staged(sheet, mapping, expected, actual, actual.sparkSession.createDataFrame([tuple(counts.values())], kinds), source.count())


def latest_files(spark: SparkSession, root: str, sheet: str) -> tuple[str, str]:
    """Newest combined source and target file of a sheet."""
    return tuple(scan.latest_extract(spark, f"{root}/{sheet}/{side}", scan.combined_name(sheet, side)) for side in ("ECC", "S4"))


def validate_latest(spark: SparkSession, root: str, sheet: str, mapping: Sequence[FieldMapping] | None = None,
                    strict_dates: bool = False) -> Staged:
    """The newest files of a sheet, transformed and staged; the caller asks for rules, one plant, all plants or a report.

    Valuation data also read the newest plant data, whose rows tell their plants.
    """
    source_path, target_path = latest_files(spark, root, sheet)
    source = scan.scan_extract(spark, source_path)
    # each table is normalised once: a material of zeros alone is empty text after it, and would be NULL after a second time
    tables = {**scan.load_tables(spark, root), sheet: normalize_extract(source, sheet, required_only=True, lean=True)}
    if sheet != "MARC":
        plants = scan.scan_extract(spark, scan.latest_extract(spark, f"{root}/MARC/ECC", scan.combined_name("MARC", "ECC")))
        tables["MARC"] = normalize_extract(plants, "MARC", required_only=True, lean=True)
    expected = transform_table(sheet, tables, strict_dates=strict_dates)
    return staged(sheet, source, expected, scan.scan_extract(spark, target_path), mapping)
