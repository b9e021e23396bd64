"""Source extracts and target tables derived from the driver tables.

Each raw extract is a SELECT both engines understand. Spark runs it and normalises the result
with the engine; the oracle normalises it with the hand-written SQL below. Every line item is a row
of plant data, so its keys repeat, and so do keys of the reference tables; ``every_line=False`` keeps
the first line item of each (part, plant) and single reference rows, as an even case to time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.functions.scalars import strip_zeros
from siteshift.layouts import REQUIRED
from siteshift.operators.lookups import KEYS
from siteshift.plans.transform import expected_plants, keyed_targets
from siteshift.sources.normalize import normalize_extract


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- #
# Raw extracts, one SELECT each for both engines
# --------------------------------------------------------------------------- #

RAW_MARA = """
SELECT lpad(CAST(CASE WHEN p_partkey % 37 = 5 THEN 700000000 + p_partkey ELSE p_partkey END AS STRING), 18, '0') AS MATNR,
       CASE WHEN p_partkey % 31 = 0 THEN 'X' END AS LVORM,
       CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'FERT' WHEN p_type = 'ECONOMY' THEN 'HALB'
            WHEN p_type = 'LARGE' THEN 'ROH' WHEN p_type = 'MEDIUM' THEN 'LEIH'
            WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN 'NVAL' WHEN p_type = 'SMALL' THEN 'UNBW' END AS MTART,
       CASE WHEN p_size % 3 = 0 THEN 'EA' ELSE 'CS' END AS MEINS,
       CASE WHEN p_size > 45 THEN '00999' WHEN p_size > 40 THEN '009990099900000999' ELSE '00100' END AS PRDHA,
       lpad(CAST(p_partkey AS STRING), 18, '0') AS _row_id
FROM {part}
"""

RAW_MARM = """
SELECT lpad(CAST(CASE WHEN p_partkey % 17 = 3 THEN 700000000 + p_partkey ELSE p_partkey END AS STRING), 18, '0') AS MATNR,
       unit.meinh AS MEINH, CASE WHEN unit.meinh = 'EA' THEN CAST(p_size % 13 AS STRING) ELSE '1' END AS UMREN,
       lpad(CAST(p_partkey AS STRING), 18, '0') || unit.meinh AS _row_id
FROM (SELECT *, 'EA' AS meinh FROM {part} UNION ALL SELECT *, 'CS' AS meinh FROM {part}) unit
"""

RAW_EKGRP = """
SELECT CAST(CASE WHEN p_partkey % 4 = 1 THEN 700000000 + p_partkey ELSE p_partkey END AS STRING) AS MATNR,
       plant.werks AS WERKS, 'G' || CAST(p_size % 9 AS STRING) AS EKGRP
FROM (SELECT *, '1021' AS werks FROM {part} UNION ALL SELECT *, '1025' AS werks FROM {part}
      UNION ALL SELECT *, '1029' AS werks FROM {part}) plant
"""

# Further rows for the same keys: a second material type, a later EA unit, a second group.
MORE_MARA = """
SELECT lpad(CAST(p_partkey AS STRING), 18, '0'), CASE WHEN p_partkey % 2 = 0 THEN 'X' END, 'FERT', 'CS', '00999',
       lpad(CAST(p_partkey AS STRING), 18, '0') || 'Z'
FROM {part} WHERE p_partkey % 19 = 1
"""
MORE_MARM = """
SELECT lpad(CAST(p_partkey AS STRING), 18, '0'), 'EA', '99', lpad(CAST(p_partkey AS STRING), 18, '0') || 'Z'
FROM {part} WHERE p_partkey % 3 = 1
"""
MORE_EKGRP = """
SELECT lpad(CAST(p_partkey AS STRING), 18, '0'), '1021', 'H' || CAST(p_size % 9 AS STRING) FROM {part} WHERE p_partkey % 5 = 1
"""


def reference_sql(repeated: bool) -> dict[str, str]:
    """SELECTs of the reference tables, with or without repeated keys."""
    more = {"MARA": MORE_MARA, "MARM": MORE_MARM, "EKGRP": MORE_EKGRP}
    once = {"MARA": RAW_MARA, "MARM": RAW_MARM, "EKGRP": RAW_EKGRP}
    return {t: f"{sql} UNION ALL {more[t]}" if repeated else sql for t, sql in once.items()}


PLANT_OF_LINE = """
CASE l_suppkey % 8 WHEN 0 THEN '1021' WHEN 1 THEN '1021' WHEN 2 THEN '1028' WHEN 3 THEN '1030'
     WHEN 4 THEN '1025' WHEN 5 THEN '1000' WHEN 6 THEN '1029' ELSE '1055' END
"""
LINE_ORDER = "l_orderkey l_linenumber l_suppkey l_extendedprice".split()
LINE_REST = "l_quantity l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
ROW_ID_OF_LINE = (
    "lpad(CAST(l_orderkey AS STRING), 12, '0') || lpad(CAST(l_linenumber AS STRING), 3, '0') || "
    "lpad(CAST(l_partkey AS STRING), 12, '0') || lpad(CAST(l_suppkey AS STRING), 9, '0') || "
    "lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 6, '0')"
)

RAW_MARC = f"""
SELECT lpad(CAST(l_partkey AS STRING), 18, '0') AS MATNR, plant AS WERKS,
       CASE WHEN l_orderkey % 29 = 0 THEN 'X' END AS LVORM,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 11 = 1 THEN 'G'
            WHEN l_returnflag = 'R' THEN 'F' WHEN l_returnflag = 'A' THEN 'E'
            WHEN l_returnflag = 'N' THEN 'X' END AS BESKZ,
       CASE l_linenumber WHEN 1 THEN '40' WHEN 2 THEN '41' WHEN 3 THEN '42' WHEN 4 THEN '30'
            WHEN 5 THEN '50' END AS SOBSL,
       CASE l_orderkey % 5 WHEN 0 THEN 'DAP1' WHEN 1 THEN 'DAP2' WHEN 2 THEN 'DAP3' WHEN 3 THEN 'PROD' END AS SFCPF,
       CASE l_orderkey % 7 WHEN 0 THEN '01' WHEN 1 THEN '02' WHEN 2 THEN 'BP' WHEN 3 THEN 'ZP'
            WHEN 4 THEN 'BR' WHEN 5 THEN '99' END AS MMSTA,
       CASE l_partkey % 7 WHEN 0 THEN d WHEN 1 THEN substr(d, 1, 4) || substr(d, 6, 2) || substr(d, 9, 2)
            WHEN 2 THEN substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)
            WHEN 3 THEN substr(d, 9, 2) || '.' || substr(d, 6, 2) || '.' || substr(d, 1, 4)
            WHEN 4 THEN '00000000' WHEN 5 THEN '2024-02-30' END AS MMSTD,
       CASE l_partkey % 3 WHEN 0 THEN CAST(month(l_shipdate) AS STRING) || '/' || CAST(day(l_shipdate) AS STRING)
                                      || '/' || CAST(year(l_shipdate) AS STRING)
            WHEN 1 THEN d || 'T00:00:00' END AS AUSDT,
       'PL0' || CAST(l_linenumber AS STRING) AS LGPRO, 'EP0' || CAST(l_linenumber AS STRING) AS LGFSB,
       CASE WHEN l_linestatus = 'O' THEN 'P1' ELSE 'PD' END AS DISMM,
       CASE WHEN l_partkey % 3 = 0 THEN 'EA' END AS AUSME,
       CASE WHEN l_partkey % 5 = 0 THEN lpad(CAST(l_partkey + 1 AS STRING), 18, '0') END AS NFMAT,
       CASE l_orderkey % 4 WHEN 0 THEN '0.00' WHEN 1 THEN '5.00' WHEN 2 THEN '0' END AS LOSFX,
       CASE WHEN l_orderkey % 6 = 0 THEN '0.000' WHEN l_orderkey % 6 > 1
            THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.500' END AS LOSGR,
       CASE WHEN l_orderkey % 3 = 0 THEN 'Z00001' ELSE 'V1' END AS AWSLS,
       CASE WHEN l_orderkey % 4 = 3 THEN 'PAL' END AS FRTME, '099' AS FEVOR,
       CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.000' AS BSTMI,
       CAST(CAST(l_quantity AS BIGINT) AS STRING) || '0.25' AS BSTMA,
       CASE WHEN l_linenumber = 7 THEN '1,000' WHEN l_linenumber = 6 THEN '1e3' END AS BSTFE,
       CASE WHEN l_linenumber < 4 THEN '0.125' END AS BSTRF,
       'C' || CAST(l_suppkey % 90 AS STRING) AS DISPO, 'PC' || CAST(l_orderkey % 13 AS STRING) AS PRCTR,
       CASE WHEN l_linenumber % 2 = 0 THEN 'X' END AS XCHPF,
       CAST(CAST(l_quantity AS BIGINT) * 3 AS STRING) || '.0' AS EISBE, ' ' AS PERIV,
       {ROW_ID_OF_LINE} AS _row_id
FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM {{lines}}) dated
"""

RAW_MBEW = """
SELECT lpad(CAST(l_partkey AS STRING), 18, '0') AS MATNR, plant AS BWKEY,
       CASE WHEN ok % 29 = 0 THEN 'X' END AS LVORM,
       CASE ok % 10 WHEN 0 THEN '~' WHEN 1 THEN 'C1' END AS BWTAR,
       CAST(CAST(p_retailprice AS DECIMAL(15, 2)) AS STRING) AS STPRS,
       'KG' || CAST(ok % 3 AS STRING) AS KOSGR,
       CASE ok % 3 WHEN 0 THEN '03/15/2024' WHEN 1 THEN '20240315' END AS ZPLD2,
       CASE ok % 4 WHEN 0 THEN '13/01/2024' WHEN 1 THEN '1.2.2024' WHEN 2 THEN '15.02.2024' END AS ZPLD3,
       'S' AS VPRSV, '1' AS PEINH, CAST(ok % 5 AS STRING) || '.00' AS BWPRS
FROM (SELECT l_partkey, plant, min(l_orderkey) AS ok FROM {lines} GROUP BY l_partkey, plant) keyed
JOIN {part} ON p_partkey = l_partkey
"""

# Further valuation rows for the same material and area: another valuation type, and a row that repeats as a whole.
MORE_MBEW = """
SELECT MATNR, BWKEY, LVORM, CASE WHEN KOSGR = 'KG1' THEN 'C2' ELSE BWTAR END AS BWTAR,
       CASE WHEN KOSGR = 'KG1' THEN '12.5' ELSE STPRS END AS STPRS, KOSGR, ZPLD2, ZPLD3, VPRSV, PEINH, BWPRS
FROM ({mbew}) once WHERE KOSGR <> 'KG2'
"""


def valuation_sql(repeated: bool) -> str:
    return f"{RAW_MBEW} UNION ALL {MORE_MBEW.replace('{mbew}', RAW_MBEW)}" if repeated else RAW_MBEW


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their plant."""
    return read(spark, sf_dir, "lineitem").withColumn("plant", F.expr(PLANT_OF_LINE))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line item of every (part, plant)."""
    first = F.min(F.struct(*LINE_ORDER, *LINE_REST)).alias("first")
    return lines(spark, sf_dir).groupBy("l_partkey", "plant").agg(first).select("l_partkey", "plant", "first.*")


def raw_extracts(spark: SparkSession, sf_dir: str, every_line: bool = True) -> dict[str, DataFrame]:
    """Raw source extracts."""
    part = read(spark, sf_dir, "part")
    picked = lines(spark, sf_dir) if every_line else first_lines(spark, sf_dir)
    return {
        **{t: spark.sql(sql, part=part) for t, sql in reference_sql(every_line).items()},
        "MARC": spark.sql(RAW_MARC, lines=picked),
        "MBEW": spark.sql(valuation_sql(every_line), lines=lines(spark, sf_dir), part=part),
    }


_PLANS: dict[tuple, dict[str, DataFrame]] = {}


def source_tables(spark: SparkSession, sf_dir: str, every_line: bool = True) -> dict[str, DataFrame]:
    """Normalised source tables, as the transformation reads them. The lazy plans (not their
    data) are kept per session, so building a query does not resolve the extracts again."""
    slot = (spark.sparkContext.applicationId, id(spark), sf_dir, every_line)
    if slot not in _PLANS:
        raw = raw_extracts(spark, sf_dir, every_line)
        _PLANS[slot] = {t: normalize_extract(df, t, required_only=True, lean=True) for t, df in raw.items()}
    return dict(_PLANS[slot])


# --------------------------------------------------------------------------- #
# Actual target tables: the expected ones with known faults
# --------------------------------------------------------------------------- #

def keyed_table(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    """The expected table with its source keys."""
    slot = (spark.sparkContext.applicationId, id(spark), sf_dir, "expected")
    plans = _PLANS.setdefault(slot, {})
    if sheet not in plans:
        plans[sheet] = keyed_targets(sheet, source_tables(spark, sf_dir))
    return plans[sheet]


def expected_table(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    return keyed_table(spark, sf_dir, sheet).drop(*KEYS)


def expected_keys(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    """Materials and plants of the expected table, with their source keys."""
    return expected_plants(sheet, source_tables(spark, sf_dir))


def with_faults(expected: DataFrame, sheet: str) -> DataFrame:
    """Actual target derived from the expected one, faults chosen by material number % 41.

    Rows are dropped behind the explode: a filter on the material would go down to the extract, and the two sides
    would no longer read one shuffle of it.
    """
    fault = F.col("PRODUCT").try_cast("bigint") % 41
    copies = F.when(fault == 1, F.array(F.lit(0), F.lit(0))).when(fault == 6, F.array(F.lit(0), F.lit(1)))
    rows = expected.withColumn("_copy", F.explode_outer(copies.when(fault != 0, F.array(F.lit(0))))).filter("_copy IS NOT NULL")
    blanked, dated = ("DISMM", "MMSTD") if sheet == "MARC" else ("BKLAS", "ZPLD2")
    changed = {
        "PRODUCT": F.when(fault == 2, F.lpad("PRODUCT", 18, "0"))
        .when(F.col("_copy") == 1, F.concat(F.lit("9"), F.col("PRODUCT"))).otherwise(F.col("PRODUCT")),
        blanked: F.when(fault == 3, F.lit(" ")).otherwise(F.col(blanked)),
        dated: F.when(fault == 4, F.lit("31-31-2024")).otherwise(F.col(dated)),
    }
    if sheet == "MARC":
        changed["LGPRO"] = F.when(fault == 5, F.lit("TOOLONG")).otherwise(F.col("LGPRO"))
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in expected.columns])


def actual_table(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    return with_faults(expected_table(spark, sf_dir, sheet), sheet)


# --------------------------------------------------------------------------- #
# Oracle side
# --------------------------------------------------------------------------- #

_RAW_COLUMNS = {
    "MARA": "MATNR LVORM MTART MEINS PRDHA".split(),
    "MARM": "MATNR MEINH UMREN".split(),
    "EKGRP": "MATNR WERKS EKGRP".split(),
    "MARC": """MATNR WERKS LVORM BESKZ SOBSL SFCPF MMSTA MMSTD AUSDT LGPRO LGFSB DISMM AUSME NFMAT LOSFX LOSGR
               AWSLS FRTME FEVOR BSTMI BSTMA BSTFE BSTRF DISPO PRCTR XCHPF EISBE PERIV""".split(),
    "MBEW": "MATNR BWKEY LVORM BWTAR STPRS KOSGR ZPLD2 ZPLD3 VPRSV PEINH BWPRS".split(),
}


def clean_sql(column: str) -> str:
    return f"regexp_replace(nullif(trim({column}), ''), '^(-?[0-9]+)\\.0+$', '\\1')"


def _normalized_sql(table: str, raw: str, row_id: bool) -> str:
    cells = []
    for c in REQUIRED[table]:
        if c not in _RAW_COLUMNS[table]:
            cells.append(f"CAST(NULL AS VARCHAR) AS {c}")
        elif c == "MATNR":
            cells.append(f"regexp_replace({clean_sql(c)}, '^0+', '') AS {c}")
        else:
            cells.append(f"{clean_sql(c)} AS {c}")
    if row_id:
        cells.append("_row_id")
    return f"SELECT {', '.join(cells)} FROM ({raw}) raw"


_LINES = f"SELECT *, {PLANT_OF_LINE} AS plant FROM lineitem"
_FIRST_LINES = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, plant
                                            ORDER BY {', '.join(LINE_ORDER + LINE_REST)}) AS rn FROM lines) n
WHERE rn = 1
"""


def ctes(every_line: bool = True) -> list[tuple[str, str]]:
    """Named SQL blocks of the normalised source tables."""
    return [
        ("lines", _LINES),
        ("first_lines", _FIRST_LINES),
        *[(f"raw_{t.lower()}", sql.format(part="part")) for t, sql in reference_sql(every_line).items()],
        ("raw_marc", RAW_MARC.format(lines="lines" if every_line else "first_lines")),
        ("raw_mbew", valuation_sql(every_line).format(lines="lines", part="part")),
        ("mara", _normalized_sql("MARA", "SELECT * FROM raw_mara", True)),
        ("marm", _normalized_sql("MARM", "SELECT * FROM raw_marm", True)),
        ("ekgrp", _normalized_sql("EKGRP", "SELECT * FROM raw_ekgrp", False)),
        ("marc", _normalized_sql("MARC", "SELECT * FROM raw_marc", True)),
        ("mbew", _normalized_sql("MBEW", "SELECT * FROM raw_mbew", False)),
    ]


# Blocks several others read; evaluated once.
_ONCE = {"marc", "expected", "actual", "paired", "changes", "facts"}


def with_sql(blocks: list[tuple[str, str]], final: str) -> str:
    """One statement: the blocks as CTEs, then the final SELECT."""
    named = [f"{name} AS {'MATERIALIZED ' if name in _ONCE else ''}({body})" for name, body in blocks]
    return "WITH " + ",\n".join(named) + "\n" + final


def source_sql(final: str, every_line: bool = True) -> str:
    return with_sql(ctes(every_line), final)
