"""Header resolution and value cleaning of raw extracts.

Headers are resolved once on the driver (metadata only); the data sees one projection. Columns
are addressed by position while names may still repeat or differ in case only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteshift.functions.scalars import blank_to_null, float_int, strip_zeros
from siteshift.layouts import ALIASES, LABELS, READ, REQUIRED

ROW_ID = "_row_id"


def by_label(header: Sequence[str], labels: Mapping[str, str], required: Sequence[str]) -> dict[str, str]:
    """Display label -> technical name, ignoring case. A header that is itself a technical name stays."""
    known = {label.upper(): field for label, field in labels.items()}
    return {h: known[h.upper()] for h in header if h.upper() in known and h.upper() not in required}


def by_alias(header: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """First accepted alias of each field the header does not already have."""
    upper = {h.upper(): h for h in header}
    names = {}
    for field, accepted in aliases.items():
        hit = next((upper[a.upper()] for a in accepted if a.upper() in upper), None)
        if field not in header and hit is not None:
            names[hit] = field
    return names


def by_case(header: Sequence[str], required: Sequence[str]) -> dict[str, str]:
    """Technical names in another case -> upper case."""
    return {h: h.upper() for h in header if h.upper() in required and h != h.upper()}


def resolve_header(header: Sequence[str], table: str) -> tuple[list[tuple[int, str]], list[str]]:
    """Kept (position, technical name) pairs, and the required fields without a column."""
    required = REQUIRED[table]
    trimmed = [h.strip() for h in header]
    names = by_case(trimmed, required)
    names.update(by_label(trimmed, LABELS.get(table, {}), required))
    names.update(by_alias(trimmed, ALIASES.get(table, {})))
    first: dict[str, int] = {}
    for position, h in enumerate(trimmed):
        first.setdefault(names.get(h, h), position)
    kept = [(position, name) for name, position in first.items()]
    return kept, [f for f in required if f not in first]


def normalize_extract(raw: DataFrame, table: str, required_only: bool = False, lean: bool = False) -> DataFrame:
    """Raw extract to technical columns: trimmed headers, labels resolved, first of repeated columns
    kept, cells cleaned, missing fields NULL, material numbers without leading zeros.

    ``required_only`` keeps just the columns the transformation reads, so the scan is pruned to them.
    ``lean`` leaves out missing fields that would only pass through, so no shuffle carries columns of NULLs.
    The ingest row id passes through untouched.
    """
    kept, missing = resolve_header(raw.columns, table)
    if required_only:
        kept = [(i, name) for i, name in kept if name in REQUIRED[table] or name == ROW_ID]
    # two projections: each cell is trimmed once, then tested
    trimmed = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]).select(
        *[(F.col(f"c{i}") if name == ROW_ID else blank_to_null(F.col(f"c{i}"))).alias(name) for i, name in kept]
    )

    def cell(name: str):
        c = F.col(f"`{name}`")
        if name == ROW_ID:
            return c
        c = float_int(c)
        return (strip_zeros(c) if name == "MATNR" else c).alias(name)

    return trimmed.select(
        *[cell(name) for _, name in kept],
        *[F.lit(None).cast("string").alias(f) for f in missing if not lean or f in READ[table]],
    )


def clean_blank(df: DataFrame) -> DataFrame:
    """Cell cleaning alone, on every column."""
    trimmed = df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return trimmed.select(*[float_int(F.col(f"`{c}`")).alias(c) for c in df.columns])


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def missing_fields(header: Sequence[str], table: str) -> list[str]:
    return resolve_header(header, table)[1]


def _renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.toDF(*[names.get(c, c) for c in df.columns])


def rename_labels(df: DataFrame, table: str) -> DataFrame:
    return _renamed(df, by_label(df.columns, LABELS[table], REQUIRED[table]))


def rename_aliases(df: DataFrame, table: str) -> DataFrame:
    return _renamed(df, by_alias(df.columns, ALIASES[table]))


def rename_technical_case(df: DataFrame, table: str) -> DataFrame:
    return _renamed(df, by_case(df.columns, REQUIRED[table]))


def dedup_columns(df: DataFrame) -> DataFrame:
    """First column of every name, by position."""
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c, i)
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"c{i}").alias(name) for name, i in first.items()])


def add_missing_columns(df: DataFrame, table: str) -> DataFrame:
    absent = [f for f in REQUIRED[table] if f not in df.columns]
    return df.select("*", *[F.lit(None).cast("string").alias(f) for f in absent])


def strip_key_zeros(df: DataFrame) -> DataFrame:
    return df.withColumn("MATNR", strip_zeros(F.col("MATNR")))
