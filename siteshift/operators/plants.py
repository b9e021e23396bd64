"""Plant derivation: which target plants a source row goes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteshift.functions.scalars import not_in
from siteshift.layouts import ROUTES, Route


def routes_of(groups: Sequence[str] | None = None) -> list[Route]:
    return [r for r in ROUTES if groups is None or r.group in groups]


def lookup(c: Column, pairs: dict[str, str]) -> Column:
    """Constant map as a CASE chain; unknown keys give NULL."""
    out = F.lit(None).cast("string")
    for key, value in pairs.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def target_to_source() -> dict[str, str]:
    """Target plant -> source plant, over all routes."""
    return {t: r.source for r in ROUTES for t in (r.external, r.inhouse) if t}


def split_sides(plant: Column, beskz: Column, sobsl: Column, sfcpf: Column) -> tuple[Column, Column]:
    """External-side and in-house-side plant of one row of a split plant.

    Rows neither rule covers keep their source plant and are filtered out later.
    """
    split = [r for r in ROUTES if r.kind == "split"]
    external = lookup(plant, {r.source: r.external for r in split})
    inhouse = lookup(plant, {r.source: r.inhouse for r in split})
    always_external = (sfcpf == "DAP3")
    both = beskz.isNull() | beskz.isin("E", "X") | ((beskz == "F") & sobsl.isNull())
    first = F.when(always_external | both | (beskz == "F"), external).otherwise(plant)
    second = (
        F.when(always_external, external)
        .when(both, inhouse)
        .when(beskz == "F", external)
        .otherwise(plant)
    )
    return first, second


def derived_plants(marc: DataFrame) -> DataFrame:
    """Distinct (MATNR, source, derived) of the split plants, remapped rows only."""
    first, second = split_sides(F.col("WERKS"), F.col("BESKZ"), F.col("SOBSL"), F.col("SFCPF"))
    return (
        marc.select("MATNR", F.col("WERKS").alias("source_plant"),
                    F.explode(F.array_distinct(F.array(first, second))).alias("derived_plant"))
        .filter(remapped(F.col("derived_plant"), F.col("source_plant")))
        .distinct()
    )


def remapped(derived: Column, source: Column) -> Column:
    """A derived plant that is still the source plant means no rule applied."""
    return F.coalesce(derived != source, F.lit(False))


def active_source_rows(table: DataFrame, plant_column: str, routes: Sequence[Route]) -> DataFrame:
    """Rows of routed plants that carry no deletion flag."""
    return table.filter(F.col(plant_column).isin(*[r.source for r in routes]) & F.col("LVORM").isNull())


def eligible_materials(mara: DataFrame) -> DataFrame:
    """Materials split plants may use: alive, of a known type other than NVAL."""
    return mara.filter(F.col("LVORM").isNull() & (F.col("MTART") != "NVAL"))


def valued_materials(mara: DataFrame) -> DataFrame:
    """Materials that may carry a valuation: alive, of a known type other than UNBW."""
    return mara.filter(F.col("LVORM").isNull() & not_in(F.col("MTART"), ["UNBW"]))
