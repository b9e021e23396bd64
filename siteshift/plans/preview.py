"""Transformation preview of plant data: the real transformation, explained row by row.

All parts hang off one paired plan (expected row with its first source row); a caller takes the
parts it shows. Nothing loops over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteshift.layouts import KNOWN_GAPS, MARC_TARGET, ROUTES
from siteshift.operators import explain
from siteshift.operators.lookups import KEYS
from siteshift.plans.transform import expected_plants, joined_packed, keyed_targets, packed_id, packed_rows, target_constants, unpacked


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    records: DataFrame
    changes: DataFrame
    report: DataFrame
    rule_counts: DataFrame
    unmapped: DataFrame
    reasons: DataFrame
    totals: DataFrame
    requested: DataFrame | None
    not_found: DataFrame | None
    available: DataFrame
    used: DataFrame


def paired_targets(tables: Mapping[str, DataFrame | None], fields: Sequence[str] = MARC_TARGET) -> DataFrame:
    """Every expected row with its first source row, as ``explain.pair_with_source`` has them, of one wide shuffle.

    The transformation and the first rows read the same exchange of packed source rows. Which row is first is told by
    the row ids alone, met by a comparison, as one more join key would shuffle the rows again; of rows that share
    their first id one is taken.
    """
    source = tables["MARC"]
    packed = packed_rows("MARC", source.filter(F.col("MATNR").isNotNull()), ROUTES)
    expected = keyed_targets("MARC", tables, joined=joined_packed("MARC", packed, tables))
    met = packed.join(explain.first_ids(source).hint("shuffle_hash"), KEYS).filter(
        (packed_id("MARC", source) <= F.col("_first")) | F.col("_first").isNull())
    first = met.groupBy(*KEYS).agg(F.min("_cells").alias("_cells"))
    wanted = explain.source_wanted(source, fields)
    narrow = unpacked("MARC", source, first, wanted).select(*KEYS, F.struct(*wanted).alias("s"))
    # one row a key: hashed, it meets the expected rows without sorting those
    return explain.pair_by_keys(expected, narrow.hint("shuffle_hash"), fields, target_constants("MARC", source))


def transformation_preview(tables: Mapping[str, DataFrame | None], requested: DataFrame | None = None,
                           limit: int | None = None, gaps: DataFrame | Sequence[explain.Gap] = KNOWN_GAPS) -> Preview:
    """Preview of the requested materials, of the first ``limit`` source rows, or of everything."""
    available = tables["MARC"]
    source = available
    if requested is not None:
        source = explain.filter_materials(source, requested)
    elif limit is not None:
        source = explain.head_rows(source, limit)
    tables = {**tables, "MARC": source}
    paired = paired_targets(tables)
    records = explain.preview_records(paired, gaps)
    unmapped = explain.preview_unmapped(source, expected_plants("MARC", tables), tables["MARA"])
    report = explain.preview_report(paired, unmapped, source, gaps)
    return Preview(
        rows=explain.preview_rows(paired_targets(tables, explain.SUMMARY_FIELDS), tables["MARA"], tables["MARM"], gaps),
        records=records,
        changes=explain.preview_changes(paired, gaps),
        report=report,
        rule_counts=explain.report_rule_counts(report),
        unmapped=unmapped,
        reasons=explain.report_reasons(report),
        totals=explain.preview_totals(report),
        requested=None if requested is None else explain.requested_materials(requested),
        not_found=None if requested is None else explain.requested_not_in_source(requested, available),
        available=available.agg(F.count(F.lit(1)).alias("total_rows_available")),
        used=source.agg(F.count(F.lit(1)).alias("ecc_rows_in")),
    )
