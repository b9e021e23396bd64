"""Source extracts -> expected target table, as one lazy plan for all plants.

Shape of the plan
-----------------
1. *Key context*, narrow: one row per (material, source plant, target plant) with everything
   the field rules look up. Source rows are pre-aggregated to their keys before any shuffle,
   so a key that holds a third of the extract contributes one row here.
2. *Wide rows*, shuffled once: the extract joins the context on (material, source plant).
3. *Distinct*: the target is a set. Equal target rows have one material and one target plant,
   hence one source plant and one key, and lie in one partition of the join already: grouping by
   the key and the varying columns shuffles nothing again. Constant columns come after it.

A hot key's join partition is split by adaptive skew handling, which then puts an exchange by
whole rows before the distinct (``tune`` allows it that), so a key is never one task's alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteshift.functions.scalars import key_of, null_safe_key
from siteshift.layouts import PLANT_COLUMN, READ, REQUIRED, Route
from siteshift.operators import marc, mbew
from siteshift.operators.lookups import KEYS, ROW_ID, ea_denominators, material_context, own_exchange, purchasing_groups
from siteshift.operators.plants import active_source_rows, lookup, routes_of, split_sides
from siteshift.sources.normalize import normalize_extract


def keyed_rows(table: DataFrame, plant_column: str, routes: Sequence[Route]) -> DataFrame:
    return active_source_rows(table, plant_column, routes).withColumns(
        {"_key": null_safe_key(F.col("MATNR")), "_source": F.col(plant_column)}
    )


def _side_flags(routes: Sequence[Route]) -> list[Column]:
    """Aggregates: does any row of the key go to the external / the in-house plant?"""
    first, second = split_sides(F.col("_source"), F.col("BESKZ"), F.col("SOBSL"), F.col("SFCPF"))
    split = [r for r in routes if r.kind == "split"]
    external = lookup(F.col("_source"), {r.source: r.external for r in split})
    inhouse = lookup(F.col("_source"), {r.source: r.inhouse for r in split})
    return [
        F.bool_or((first == external) | (second == external)).alias("_to_external"),
        F.bool_or(second == inhouse).alias("_to_inhouse"),
    ]


def target_keys(sheet: str, rows: DataFrame, marc_table: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """(_key, _source, _target, _split): the targets of every source key.

    The plants of split routes always derive from plant data, also for valuation rows.
    """
    if sheet == "MARC":
        keys = rows.groupBy(*KEYS).agg(*_side_flags(routes))
    else:
        split = [r for r in routes if r.kind == "split"]
        flags = keyed_rows(marc_table, "WERKS", split).groupBy(*KEYS).agg(*_side_flags(split))
        keys = rows.select(*KEYS).distinct().join(flags, KEYS, "left")
    external = lookup(F.col("_source"), {r.source: r.external for r in routes})
    inhouse = lookup(F.col("_source"), {r.source: r.inhouse for r in routes if r.inhouse})
    is_split = F.col("_source").isin(*[r.source for r in routes if r.kind == "split"])
    targets = F.array_compact(F.array(
        F.when(~is_split | F.col("_to_external"), external),
        F.when(is_split & F.col("_to_inhouse"), inhouse),
    ))
    return keys.select(*KEYS, is_split.alias("_split"), F.explode(targets).alias("_target"))


def kept_keys(sheet: str, rows: DataFrame, tables: Mapping[str, DataFrame | None],
              routes: Sequence[Route]) -> DataFrame:
    """Targets of the source keys whose material passes the filters, once for each of its attributes."""
    keys = target_keys(sheet, rows, tables["MARC"], routes)
    ctx = (
        keys.join(material_context(tables["MARA"]), "_key", "left")
        .filter(F.coalesce(F.col("_kept"), F.lit(True)))
        .filter(~F.col("_split") | F.col("_eligible"))
    )
    return ctx.filter(F.col("_valued")) if sheet == "MBEW" else ctx


def key_context(sheet: str, rows: DataFrame, tables: Mapping[str, DataFrame | None],
                routes: Sequence[Route]) -> DataFrame:
    """Narrow lookup side of the transformation; see the module notes."""
    ctx = kept_keys(sheet, rows, tables, routes).join(ea_denominators(tables["MARM"]), "_key", "left")
    looked_up = ["_mtart", "_meins", "_prdha", "_umren"] if sheet == "MBEW" else ["_mtart", "_meins", "_umren"]
    if sheet == "MARC":
        if tables.get("EKGRP") is not None:
            ctx = ctx.join(purchasing_groups(tables["EKGRP"]), KEYS, "left")
        else:
            ctx = ctx.withColumn("_ekgrp", F.lit(None).cast("string"))
        looked_up.append("_ekgrp")
    return ctx.select(*KEYS, "_target", *looked_up)


def expected_plants(sheet: str, tables: Mapping[str, DataFrame | None], groups: Sequence[str] | None = None) -> DataFrame:
    """(_key, _source, PRODUCT, plant): the materials and plants of the expected table as a set, without its field rules.

    Keys come from the active rows themselves and every row meets its key's targets, so a target of a kept key has
    an expected row and there is no other. What asks for keys alone shuffles no wide row.
    """
    routes = routes_of(groups)
    rows = keyed_rows(tables[sheet], PLANT_COLUMN[sheet], routes)
    found = kept_keys(sheet, rows, tables, routes).select(*KEYS, "_target").distinct()
    return found.select(*KEYS, key_of(F.col("_key")).alias("PRODUCT"), F.col("_target").alias(PLANT_COLUMN[sheet]))


def absent_fields(sheet: str, table: DataFrame) -> list[str]:
    """Fields that would pass through, had the extract a column of them."""
    return [f for f in REQUIRED[sheet] if f not in READ[sheet] and f not in table.columns]


def attach_context(sheet: str, rows: DataFrame, ctx: DataFrame) -> DataFrame:
    """Wide rows joined to their narrow context; fields the extract lacks, and those the keys tell, are added
    behind the shuffle.

    The context's own exchange gives adaptive execution statistics for both sides: an empty context removes
    the join and all above it, a hot partition is split, and the context is hashed where it was measured small.
    """
    absent = [F.lit(None).cast("string").alias(f) for f in absent_fields(sheet, rows)]
    told = {"MATNR": key_of(F.col("_key")), PLANT_COLUMN[sheet]: F.col("_source")}
    return rows.drop(*told).join(own_exchange(ctx, *KEYS), KEYS).select("*", *[c.alias(f) for f, c in told.items()], *absent)


def joined_rows(sheet: str, tables: Mapping[str, DataFrame | None],
                groups: Sequence[str] | None = None) -> DataFrame:
    """Source rows with their key context: what the field rules are written against."""
    routes = routes_of(groups)
    rows = keyed_rows(tables[sheet], PLANT_COLUMN[sheet], routes)
    return prepared(sheet, attach_context(sheet, rows, key_context(sheet, rows, tables, routes)))


def prepared(sheet: str, joined: DataFrame) -> DataFrame:
    return marc.with_numbers(joined) if sheet == "MARC" else joined


def packed_fields(sheet: str, table: DataFrame) -> list[str]:
    return [f for f in table.columns if f not in ("MATNR", PLANT_COLUMN[sheet], ROW_ID)]


def packed_rows(sheet: str, table: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Rows of routed plants, deleted ones as well: their keys, and all their other cells as one JSON array of texts,
    with the row id on a line of its own behind it.

    One text takes fewer shuffle bytes than a column per cell, and plans that need different cells of it, or other
    rows, still have one exchange in common.
    """
    cells = [F.col(f).cast("string") for f in packed_fields(sheet, table)]
    rows = table.filter(F.col(PLANT_COLUMN[sheet]).isin(*[r.source for r in routes])).select(
        *table.columns, F.explode(F.array(F.lit(0))).alias("_one"))  # else the expressions of all cells become one
    packed = F.concat(F.to_json(F.array(*cells)), F.lit("\n"), null_safe_key(F.col(ROW_ID).cast("string")))
    return rows.select(null_safe_key(F.col("MATNR")).alias("_key"), F.col(PLANT_COLUMN[sheet]).alias("_source"), packed.alias("_cells"))


def packed_id(sheet: str, table: DataFrame) -> Column:
    """Row id of a packed row; its cells hold no line break of their own, so nothing is parsed for it."""
    return key_of(F.substr("_cells", F.locate("\n", F.col("_cells")) + F.lit(1))).cast(dict(table.dtypes)[ROW_ID])


def unpacked(sheet: str, table: DataFrame, rows: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Packed rows with the wanted cells (all, by default) as columns of the types they had, behind their text.

    A generator makes the array of cells: no condition on them goes down below an exchange of packed rows, and no rule
    is worked out on the text itself. An outer one, as a filter would be inferred for an inner one.
    """
    packed = packed_fields(sheet, table)
    kinds = dict(table.dtypes)
    wanted = packed if fields is None else fields
    cells = [F.col("_cell")[packed.index(f)].cast(kinds[f]).alias(f) for f in wanted if f != ROW_ID]
    ids = [packed_id(sheet, table).alias(ROW_ID)] if ROW_ID in wanted else []
    parsed = F.from_json(F.substring_index("_cells", "\n", 1), "array<string>")
    return rows.select(*rows.columns, F.explode_outer(F.array(parsed)).alias("_cell")).select(*rows.columns, *cells, *ids)


def joined_packed(sheet: str, packed: DataFrame, tables: Mapping[str, DataFrame | None],
                  groups: Sequence[str] | None = None) -> DataFrame:
    """``joined_rows`` of packed rows. The planner takes their long text for a short one and would broadcast it, so the
    narrow side is named as the one to hash."""
    routes, table = routes_of(groups), tables[sheet]
    ctx = key_context(sheet, keyed_rows(table, PLANT_COLUMN[sheet], routes), tables, routes)
    absent = [F.lit(None).cast("string").alias(f) for f in absent_fields(sheet, table)]
    met = unpacked(sheet, table, packed.join(own_exchange(ctx, *KEYS).hint("shuffle_hash"), KEYS)).filter(F.col("LVORM").isNull())
    return prepared(sheet, met.select("*", key_of(F.col("_key")).alias("MATNR"), F.col("_source").alias(PLANT_COLUMN[sheet]), *absent))


def target_rules(sheet: str, strict_dates: bool = False) -> dict[str, Column]:
    """Strict dates concern valuation data only: month first, and nothing else."""
    return marc.target_rules() if sheet == "MARC" else mbew.target_rules(strict_dates)


def target_constants(sheet: str, table: DataFrame) -> dict[str, Column]:
    """Target fields with one value in every row: the rule book's, and those whose source column the extract lacks."""
    rules = target_rules(sheet)
    constant = {f: rules[f] for f in (marc.CONSTANT if sheet == "MARC" else mbew.CONSTANT)}
    return constant | {f: F.lit(None).cast("string") for f in absent_fields(sheet, table)}


def keyed_targets(sheet: str, tables: Mapping[str, DataFrame | None],
                  groups: Sequence[str] | None = None, strict_dates: bool = False,
                  joined: DataFrame | None = None) -> DataFrame:
    """Expected target rows with their source keys, by which they still lie; see ``transform_table``.

    ``joined``: the source rows with their key context, where a caller has them already.
    """
    rules, constants = target_rules(sheet, strict_dates), target_constants(sheet, tables[sheet])
    found = (joined_rows(sheet, tables, groups) if joined is None else joined).select(
        *KEYS, *[rule.alias(f) for f, rule in rules.items() if f not in constants]).distinct()
    return found.select(*KEYS, *[constants.get(f, F.col(f)).alias(f) for f in rules])


def transform_table(sheet: str, tables: Mapping[str, DataFrame | None],
                    groups: Sequence[str] | None = None, strict_dates: bool = False) -> DataFrame:
    """Expected target table of one sheet, all plants or the given plant groups, as a set.

    ``tables`` holds normalised MARC, MBEW, MARA, MARM and optionally EKGRP.
    """
    return keyed_targets(sheet, tables, groups, strict_dates).drop(*KEYS)


def sort_output(expected: DataFrame, sheet: str) -> DataFrame:
    """Display order. The transformation itself is a set and never pays for this."""
    return expected.orderBy("PRODUCT", PLANT_COLUMN[sheet])


def build_expected(sheet: str, extracts: Mapping[str, DataFrame | None],
                   groups: Sequence[str] | None = None, strict_dates: bool = False) -> DataFrame:
    """Raw extracts (labelled or technical headers) to the expected target table; tables normalised before go to
    ``transform_table``, as a second normalisation would make NULL of a material of zeros alone."""
    if sheet not in PLANT_COLUMN:
        raise ValueError(f"unsupported sheet {sheet!r}")
    needed = ["MARA", "MARM", "MARC"] + (["MBEW"] if sheet == "MBEW" else [])
    missing = [t for t in needed if extracts.get(t) is None]
    if missing:
        raise ValueError(f"cannot transform {sheet} without {', '.join(missing)}")
    tables = {t: normalize_extract(df, t, required_only=True, lean=True) for t, df in extracts.items() if df is not None}
    return transform_table(sheet, tables, groups, strict_dates)
