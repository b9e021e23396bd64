"""Queries of the filters, joins, plant derivation, field rules and assembly of the transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.functions.scalars import null_safe_key
from siteshift.layouts import MARC_BLANK, MARC_PASS, MBEW_PASS, ROUTES
from siteshift.operators import explain, lookups, marc, mbew, plants
from siteshift.plans import transform as t
from workload.expected_sql import MARC_RULES, MBEW_RULES, context_ctes, fields_sql, transform_sql
from workload.extracts import lines, raw_extracts, source_sql, source_tables, with_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, oracle: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = oracle


def over(table: str, build):
    """Query over one normalised source table."""
    return lambda spark, sf_dir: build(source_tables(spark, sf_dir)[table])


KEY = ("MATNR", "WERKS")
ALL = list(ROUTES)

# --- filters -------------------------------------------------------------- #
register("filter_source_rows",
         over("MARC", lambda d: plants.active_source_rows(d, "WERKS", ALL).select(*KEY)),
         source_sql("SELECT MATNR, WERKS FROM marc WHERE LVORM IS NULL AND WERKS IN ('1021', '1028', '1030', '1025', '1000', '1029')"))
register("filter_eligible_materials",
         over("MARA", lambda d: plants.eligible_materials(d).select("MATNR", "MTART")),
         source_sql("SELECT MATNR, MTART FROM mara WHERE LVORM IS NULL AND MTART <> 'NVAL'"))
register("filter_marc_active",
         over("MARC", lambda d: plants.active_source_rows(d, "WERKS", plants.routes_of(["1021"])).select(*KEY, "BESKZ")),
         source_sql("SELECT MATNR, WERKS, BESKZ FROM marc WHERE LVORM IS NULL AND WERKS = '1021'"))


def _with_mara(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = source_tables(spark, sf_dir)
    rows = tables["MARC"].select(*KEY, null_safe_key(F.col("MATNR")).alias("_key"))
    return rows.join(lookups.material_context(tables["MARA"]), "_key", "left")


register("filter_not_nval",
         lambda spark, sf: _with_mara(spark, sf).filter(F.coalesce("_kept", F.lit(True)))
         .select(*KEY, F.col("_mtart").alias("MTART")),
         source_sql("""SELECT m.MATNR, m.WERKS, a.MTART FROM marc m LEFT JOIN mara a ON m.MATNR IS NOT DISTINCT FROM a.MATNR
                       WHERE a.MTART IS DISTINCT FROM 'NVAL' AND a.LVORM IS NULL"""))
register("filter_mara_not_deleted",
         lambda spark, sf: (lambda tb: tb["MARC"].select(*KEY).join(
             tb["MARA"].select("MATNR", F.col("LVORM").alias("deleted")), "MATNR", "left")
             .filter(F.col("deleted").isNull()).select(*KEY))(source_tables(spark, sf)),
         source_sql("SELECT m.MATNR, m.WERKS FROM marc m LEFT JOIN mara a ON m.MATNR = a.MATNR WHERE a.LVORM IS NULL"))

_SIDES = """SELECT MATNR, WERKS, {side} AS derived FROM marc JOIN
  (VALUES ('1021', 'US30', 'US27'), ('1028', 'US31', 'US28'), ('1030', 'US33', 'US32')) p(plant, x, y) ON WERKS = plant"""
_X_SIDE = ("CASE WHEN SFCPF = 'DAP3' OR BESKZ IN ('F', 'E', 'X') OR BESKZ IS NULL THEN x ELSE WERKS END")
_Y_SIDE = ("CASE WHEN SFCPF = 'DAP3' THEN x WHEN BESKZ = 'F' AND SOBSL IS NOT NULL THEN x "
           "WHEN BESKZ IN ('F', 'E', 'X') OR BESKZ IS NULL THEN y ELSE WERKS END")


def _side(position: int):
    def build(d: DataFrame) -> DataFrame:
        sides = plants.split_sides(F.col("WERKS"), F.col("BESKZ"), F.col("SOBSL"), F.col("SFCPF"))
        return d.filter(F.col("WERKS").isin("1021", "1028", "1030")).select(*KEY, sides[position].alias("derived"))

    return build


register("filter_remapped_plants",
         over("MARC", lambda d: _side(1)(d).filter(plants.remapped(F.col("derived"), F.col("WERKS")))),
         source_sql(f"SELECT * FROM ({_SIDES.format(side=_Y_SIDE)}) s WHERE derived <> WERKS"))
register("filter_mbew_materials",
         lambda spark, sf: (lambda tb: tb["MBEW"].join(
             plants.valued_materials(tb["MARA"]).select("MATNR").distinct(), "MATNR", "left_semi")
             .select("MATNR", "BWKEY"))(source_tables(spark, sf)),
         source_sql("""SELECT MATNR, BWKEY FROM mbew WHERE MATNR IN
                       (SELECT MATNR FROM mara WHERE MTART <> 'UNBW' AND LVORM IS NULL)"""))

# --- plant derivation ------------------------------------------------------ #
_DIRECT = {r.source: r.external for r in ROUTES if r.kind == "direct"}
register("derive_plant_single",
         over("MARC", lambda d: d.filter("WERKS = '1025'").select(*KEY, plants.lookup(F.col("WERKS"), _DIRECT).alias("derived"))),
         source_sql("SELECT MATNR, WERKS, 'US29' AS derived FROM marc WHERE WERKS = '1025'"))
register("derive_plant_other",
         over("MARC", lambda d: d.filter("WERKS IN ('1000', '1029')").select(
             *KEY, plants.lookup(F.col("WERKS"), _DIRECT).alias("derived"))),
         source_sql("""SELECT MATNR, WERKS, CASE WERKS WHEN '1000' THEN 'US26' ELSE 'CA02' END AS derived
                       FROM marc WHERE WERKS IN ('1000', '1029')"""))
register("derive_plant_split",
         lambda spark, sf: (lambda tb: plants.derived_plants(
             plants.active_source_rows(tb["MARC"], "WERKS", [r for r in ROUTES if r.kind == "split"])
             .join(plants.eligible_materials(tb["MARA"]).select("MATNR").distinct(), "MATNR", "left_semi")))(
             source_tables(spark, sf)),
         transform_sql("MARC").rsplit("SELECT DISTINCT", 1)[0]
         + "SELECT MATNR, src AS source_plant, dw AS derived_plant FROM derived")
register("derive_plant_duplicates",
         lambda spark, sf: (lambda tb: plants.derived_plants(
             plants.active_source_rows(tb["MARC"], "WERKS", [r for r in ROUTES if r.kind == "split"])
             .join(plants.eligible_materials(tb["MARA"]).select("MATNR").distinct(), "MATNR", "left_semi")))(
             source_tables(spark, sf)),
         transform_sql("MARC").rsplit("SELECT DISTINCT", 1)[0]
         + "SELECT MATNR, src AS source_plant, dw AS derived_plant FROM derived")
register("plant_reverse_map",
         lambda spark, sf: t.expected_plants("MARC", source_tables(spark, sf)).select(
             "PRODUCT", "WERKS", plants.lookup(F.col("WERKS"), plants.target_to_source()).alias("source_plant")).distinct(),
         transform_sql("MARC").rsplit("SELECT DISTINCT", 1)[0]
         + """SELECT DISTINCT MATNR AS PRODUCT, dw AS WERKS, CASE WHEN dw IN ('US30', 'US27') THEN '1021'
              WHEN dw IN ('US31', 'US28') THEN '1028' WHEN dw IN ('US33', 'US32') THEN '1030' WHEN dw = 'US29' THEN '1025'
              WHEN dw = 'US26' THEN '1000' WHEN dw = 'CA02' THEN '1029' END AS source_plant FROM marc_d""")

# --- joins ----------------------------------------------------------------- #
register("join_marc_eligible",
         lambda spark, sf: (lambda tb: plants.active_source_rows(tb["MARC"], "WERKS", [r for r in ROUTES if r.kind == "split"])
                            .join(plants.eligible_materials(tb["MARA"]).select("MATNR", "MTART"), "MATNR").select(*KEY, "MTART"))(
             source_tables(spark, sf)),
         source_sql("""SELECT m.MATNR, m.WERKS, a.MTART FROM marc m JOIN mara a ON m.MATNR = a.MATNR
                       WHERE m.LVORM IS NULL AND m.WERKS IN ('1021', '1028', '1030') AND a.LVORM IS NULL AND a.MTART <> 'NVAL'"""))


def _base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = source_tables(spark, sf_dir)
    routes = plants.routes_of(["1021", "1028", "1030"])
    rows = t.keyed_rows(tables["MARC"], "WERKS", routes)
    keys = t.target_keys("MARC", rows, tables["MARC"], routes)
    return rows.join(keys, t.KEYS).select("MATNR", "WERKS", "BESKZ", "LOSGR", F.col("_target").alias("derived"))


register("join_base_rows", _base_rows, source_sql(
    f"""SELECT r.MATNR, r.WERKS, r.BESKZ, r.LOSGR, b.derived FROM marc r JOIN (
          SELECT DISTINCT MATNR, WERKS, derived FROM (
            {_SIDES.format(side=_X_SIDE)} WHERE LVORM IS NULL UNION ALL {_SIDES.format(side=_Y_SIDE)} WHERE LVORM IS NULL) s
          WHERE derived <> WERKS) b
        ON r.MATNR IS NOT DISTINCT FROM b.MATNR AND r.WERKS = b.WERKS WHERE r.LVORM IS NULL"""))
register("join_mara_context",
         lambda spark, sf: (lambda tb: tb["MARC"].select(*KEY).join(
             tb["MARA"].select("MATNR", "MTART", "MEINS", "PRDHA", F.col("LVORM").alias("mara_lvorm")), "MATNR", "left"))(
             source_tables(spark, sf)),
         source_sql("""SELECT m.MATNR, m.WERKS, a.MTART, a.MEINS, a.PRDHA, a.LVORM AS mara_lvorm
                       FROM marc m LEFT JOIN mara a ON m.MATNR = a.MATNR"""))
_EA = ("(SELECT MATNR, UMREN FROM (SELECT *, row_number() OVER (PARTITION BY MATNR ORDER BY _row_id) AS rn "
       "FROM marm WHERE MEINH = 'EA') e WHERE rn = 1)")
register("join_marm_ea",
         lambda spark, sf: (lambda tb: tb["MARC"].select(*KEY, null_safe_key(F.col("MATNR")).alias("_key")).join(
             lookups.ea_denominators(tb["MARM"]), "_key", "left").select(*KEY, F.col("_umren").alias("UMREN")))(
             source_tables(spark, sf)),
         source_sql(f"SELECT m.MATNR, m.WERKS, ea.UMREN FROM marc m LEFT JOIN {_EA} ea ON m.MATNR IS NOT DISTINCT FROM ea.MATNR"))
register("join_ekgrp",
         lambda spark, sf: (lambda tb: t.keyed_rows(tb["MARC"], "WERKS", ALL).join(
             lookups.purchasing_groups(tb["EKGRP"]), t.KEYS, "left").select(*KEY, F.col("_ekgrp").alias("EKGRP")))(
             source_tables(spark, sf)),
         source_sql("""SELECT m.MATNR, m.WERKS, g.EKGRP FROM marc m LEFT JOIN (SELECT DISTINCT MATNR, WERKS, EKGRP FROM ekgrp) g
                       ON m.MATNR = g.MATNR AND m.WERKS = g.WERKS
                       WHERE m.LVORM IS NULL AND m.WERKS IN ('1021', '1028', '1030', '1025', '1000', '1029')"""))
QUERIES["semi_mbew_materials"] = lambda spark, sf: (
    lambda tb: plants.active_source_rows(tb["MBEW"], "BWKEY", ALL).join(
        plants.valued_materials(tb["MARA"]).select("MATNR").distinct(), "MATNR", "left_semi")
    .select("MATNR", "BWKEY", "STPRS"))(source_tables(spark, sf))
ORACLE["semi_mbew_materials"] = source_sql(
    """SELECT MATNR, BWKEY, STPRS FROM mbew WHERE LVORM IS NULL AND BWKEY IN ('1021', '1028', '1030', '1025', '1000', '1029')
       AND MATNR IN (SELECT MATNR FROM mara WHERE MTART <> 'UNBW' AND LVORM IS NULL)""")

# --- field rules ------------------------------------------------------------ #


def _fields(sheet: str, fields: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = marc.derived_fields() if sheet == "MARC" else mbew.derived_fields()
        constants = {f: F.lit("") for f in MARC_BLANK}
        columns = [(rules.get(f, constants.get(f, F.col(f)))).alias(f) for f in fields]
        return t.joined_rows(sheet, source_tables(spark, sf_dir)).select(*columns).distinct()

    return query


for _f in MARC_RULES:
    _wanted = list(dict.fromkeys(["PRODUCT", "WERKS", _f]))
    register(f"marc_{_f}", _fields("MARC", _wanted), transform_sql("MARC", _wanted))
for _f in MBEW_RULES:
    _wanted = list(dict.fromkeys(["PRODUCT", "BWKEY", "BWTAR", _f]))
    register(f"mbew_{_f}", _fields("MBEW", _wanted), transform_sql("MBEW", _wanted))
register("marc_passthrough", _fields("MARC", ["PRODUCT", "WERKS", *MARC_PASS]),
         transform_sql("MARC", ["PRODUCT", "WERKS", *MARC_PASS]))
register("marc_blank", _fields("MARC", ["PRODUCT", "WERKS", *MARC_BLANK]),
         transform_sql("MARC", ["PRODUCT", "WERKS", *MARC_BLANK]))
register("mbew_passthrough", _fields("MBEW", ["PRODUCT", "BWKEY", "BWTAR", *MBEW_PASS]),
         transform_sql("MBEW", ["PRODUCT", "BWKEY", "BWTAR", *MBEW_PASS]))
register("fn_lot_rule", _fields("MARC", ["PRODUCT", "WERKS", "BSTMI", "BSTMA", "BSTFE", "BSTRF"]),
         transform_sql("MARC", ["PRODUCT", "WERKS", "BSTMI", "BSTMA", "BSTFE", "BSTRF"]))

# --- assembly ---------------------------------------------------------------- #
register("transform_marc", lambda spark, sf: t.transform_table("MARC", source_tables(spark, sf)), transform_sql("MARC"))
register("transform_mbew", lambda spark, sf: t.transform_table("MBEW", source_tables(spark, sf)), transform_sql("MBEW"))
register("transform_marc_repeated_keys",
         lambda spark, sf: t.transform_table("MARC", source_tables(spark, sf)),
         transform_sql("MARC"))
register("transform_mbew_repeated_keys",
         lambda spark, sf: t.transform_table("MBEW", source_tables(spark, sf)),
         transform_sql("MBEW"))
register("transform_table",
         lambda spark, sf: t.transform_table("MARC", source_tables(spark, sf), groups=["1025", "1000_1029"]),
         transform_sql("MARC") + " WHERE WERKS IN ('1025', '1000', '1029')")
register("build_view",
         lambda spark, sf: t.transform_table("MARC", source_tables(spark, sf), groups=["1021"]),
         transform_sql("MARC") + " WHERE WERKS = '1021'")
register("build_expected", lambda spark, sf: t.build_expected("MBEW", raw_extracts(spark, sf)), transform_sql("MBEW"))
register("sort_output",
         lambda spark, sf: t.sort_output(t.transform_table("MARC", source_tables(spark, sf)), "MARC").select(
             "PRODUCT", "WERKS", "MTVFP"),
         with_sql(context_ctes() + [("expected", fields_sql("MARC"))], "SELECT PRODUCT, WERKS, MTVFP FROM expected ORDER BY 1, 2"))

# --- set operations ----------------------------------------------------------- #
register("distinct_rows",
         lambda spark, sf: lines(spark, sf).select("plant", "l_returnflag", "l_linenumber", "l_linestatus").distinct(),
         source_sql("SELECT DISTINCT plant, l_returnflag, l_linenumber, l_linestatus FROM lines"))


def _both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = source_tables(spark, sf_dir)["MARC"]
    return _side(0)(d).unionByName(_side(1)(d))


register("union_sides", _both_sides,
         source_sql(f"{_SIDES.format(side=_X_SIDE)} UNION ALL {_SIDES.format(side=_Y_SIDE)}"))
_ROWS_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity"
register("first_per_key",
         lambda spark, sf: lookups.first_per_key(
             lines(spark, sf).select("l_partkey", "plant", "l_orderkey", "l_linenumber", "l_returnflag",
                                     F.struct(*_ROWS_ORDER.split(", ")).alias("_row_id")),
             ["l_partkey"]).drop("_row_id"),
         source_sql(f"""SELECT l_partkey, plant, l_orderkey, l_linenumber, l_returnflag FROM (
             SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ROWS_ORDER}) AS k FROM lines) n WHERE k = 1"""))
register("last_per_key",
         lambda spark, sf: lookups.last_per_key(
             lines(spark, sf).withColumn("_row_id", F.struct(*_ROWS_ORDER.split(", "))), "l_partkey",
             ["plant", "l_returnflag"]),
         source_sql(f"""SELECT l_partkey, plant, l_returnflag FROM (SELECT *, row_number() OVER (
             PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in _ROWS_ORDER.split(', '))}) AS k FROM lines) n
             WHERE k = 1"""))
register("distinct_lookup",
         lambda spark, sf: (lambda g: lookups.purchasing_groups(g.unionByName(g)).select(
             F.expr("substring(_key, 2)").alias("MATNR"), F.col("_source").alias("WERKS"), F.col("_ekgrp").alias("EKGRP")))(
             source_tables(spark, sf)["EKGRP"]),
         source_sql("SELECT DISTINCT MATNR, WERKS, EKGRP FROM (SELECT * FROM ekgrp UNION ALL SELECT * FROM ekgrp) e"))
register("limit_head",
         over("MARC", lambda d: explain.head_rows(d, 100).select(*KEY, "BESKZ", "LOSGR")),
         source_sql("SELECT MATNR, WERKS, BESKZ, LOSGR FROM marc ORDER BY _row_id LIMIT 100"))
