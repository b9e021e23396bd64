"""Queries of the scalar functions, over texts of many shapes derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteshift.functions import scalars as s
from workload.extracts import read

# One text per event, in the shapes a damaged extract shows.
TEXTS = """
SELECT event_id, CASE event_id % 14
    WHEN 0 THEN n WHEN 1 THEN '00' || n WHEN 2 THEN n || 'd' WHEN 3 THEN '1,' || lpad(k, 3, '0') WHEN 4 THEN 'nan'
    WHEN 5 THEN k || '.000' WHEN 6 THEN '  ' || n || ' ' WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN k || 'e3'
    WHEN 10 THEN '-' || n WHEN 11 THEN event_type WHEN 12 THEN '000' ELSE k END AS t,
  CASE event_id % 5 WHEN 0 THEN '3' WHEN 1 THEN '0' WHEN 2 THEN NULL WHEN 3 THEN '7' ELSE '12' END AS u
FROM (SELECT *, CAST(event_id % 977 AS STRING) AS k,
             CAST(event_id % 977 AS STRING) || '.' || lpad(CAST(event_id * 7 % 1000 AS STRING), 3, '0') AS n
      FROM {events}) numbered
"""

# One date text per event in ten layouts, some of them of days that do not exist.
DATES = """
SELECT event_id, CASE event_id % 10
    WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN y || m || d WHEN 2 THEN y || '/' || m || '/' || d
    WHEN 3 THEN CAST(event_id % 12 + 1 AS STRING) || '/' || CAST(event_id % 31 + 1 AS STRING) || '/' || y
    WHEN 4 THEN d || '.' || m || '.' || y WHEN 5 THEN y || '-' || m || '-' || d || 'T10:00:00'
    WHEN 6 THEN '00000000' WHEN 7 THEN '13/01/' || y WHEN 8 THEN ' ' || y || '-' || m || '-' || d || ' ' END AS t
FROM (SELECT *, CAST(2000 + event_id % 30 AS STRING) AS y, lpad(CAST(event_id % 12 + 1 AS STRING), 2, '0') AS m,
             lpad(CAST(event_id % 31 + 1 AS STRING), 2, '0') AS d FROM {events}) parts
"""


def _over(sql: str, expression):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(sql, events=read(spark, sf_dir, "events"))
        return rows.select("event_id", expression().alias("result"))

    return query


def _oracle(sql: str, expression: str) -> str:
    return f"WITH texts AS ({sql.format(events='events')}) SELECT event_id, {expression} AS result FROM texts"


_NUM = "CASE WHEN isnan(TRY_CAST(trim(t) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(t) AS DOUBLE) END"
_FMT = "rtrim(rtrim(printf('%.6f', {x}), '0'), '.')"


def _iso(layouts: str) -> str:
    return f"CAST(CAST(try_strptime(trim(t), [{layouts}]) AS DATE) AS VARCHAR)"


_PRICE = """CASE WHEN u IS NULL OR u = '0' OR trim(t) = '' OR TRY_CAST(trim(t) AS DECIMAL(20, 6)) IS NULL THEN NULL
  WHEN t LIKE '%,%' THEN NULL ELSE
  CASE WHEN trim(t) LIKE '-%' THEN '-' ELSE '' END ||
  CAST(((2 * abs(CAST(TRY_CAST(trim(t) AS DECIMAL(20, 6)) * 1000 AS BIGINT)) + 10 * CAST(u AS BIGINT))
        // (20 * CAST(u AS BIGINT))) // 100 AS VARCHAR) || '.' ||
  lpad(CAST(((2 * abs(CAST(TRY_CAST(trim(t) AS DECIMAL(20, 6)) * 1000 AS BIGINT)) + 10 * CAST(u AS BIGINT))
        // (20 * CAST(u AS BIGINT))) % 100 AS VARCHAR), 2, '0') END"""

_TEXT_CASES = {
    "fn_ne": (lambda: s.ne(F.col("t"), "000"), "coalesce(t <> '000', false)"),
    "fn_notin": (lambda: s.not_in(F.col("t"), ["000", "click", ""]), "coalesce(t NOT IN ('000', 'click', ''), false)"),
    "fn_num": (lambda: s.num(F.col("t")), _NUM),
    "fn_strip_zeros": (lambda: s.strip_zeros(F.col("t")), "regexp_replace(t, '^0+', '')"),
    "fn_fmt_num": (lambda: s.fmt_num(s.num(F.col("t")) * 2.5),
                   f"CASE WHEN ({_NUM}) IS NULL THEN NULL ELSE {_FMT.format(x=f'({_NUM}) * 2.5')} END"),
    "fn_case": (lambda: s.case([(F.col("t") == "000", "zeros"), (F.col("u") == "3", F.col("t")), (F.col("t") == "", "empty")],
                               F.col("u")),
                "CASE WHEN t = '000' THEN 'zeros' WHEN u = '3' THEN t WHEN t = '' THEN 'empty' ELSE u END"),
    "fn_unit_price": (lambda: s.unit_price(F.col("t"), F.col("u")), _PRICE),
    "fn_txt": (lambda: s.txt(F.col("t")), "trim(coalesce(t, ''))"),
    "fn_norm": (lambda: s.blank_to_null(F.col("t")), "nullif(trim(t), '')"),
    "fn_same": (lambda: s.same(F.col("t"), F.regexp_replace("t", "^0+", "")),
                "(t IS NOT DISTINCT FROM regexp_replace(t, '^0+', '')) OR coalesce("
                "TRY_CAST(nullif(t, 'nan') AS DOUBLE) = TRY_CAST(nullif(regexp_replace(t, '^0+', ''), 'nan') AS DOUBLE), false)"),
    "fn_is_number": (lambda: s.is_number(F.col("t")),
                     "trim(coalesce(t, '')) = '' OR TRY_CAST(replace(trim(t), ',', '') AS DOUBLE) IS NOT NULL"),
    "fn_too_long": (lambda: s.too_long(F.col("t"), 6), "coalesce(length(trim(t)) > 6, false)"),
    "fn_key_cleanup": (lambda: s.material_key(F.col("t")),
                       "regexp_replace(regexp_replace(trim(t), '\\.0+$', ''), '^0+', '')"),
    "fn_plant_text": (lambda: s.plant_text(F.col("t")), "upper(trim(coalesce(t, '')))"),
    "fn_match_key": (lambda: s.match_key([("PRODUCT", F.col("t")), ("WERKS", F.col("u"))]),
                     "regexp_replace(upper(trim(coalesce(t, ''))), '^0+', '') || chr(9247) || upper(trim(coalesce(u, '')))"),
    "filter_blank": (lambda: s.is_blank(F.col("t")), "t IS NULL OR trim(t) = ''"),
    "clean_float_int": (lambda: s.float_int(F.col("t")), "regexp_replace(t, '^(-?[0-9]+)\\.0+$', '\\1')"),
}
_DATE_CASES = {
    "fn_parse_date": (lambda: s.parse_date(F.col("t")),
                      _iso("'%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y%m%d', '%Y/%m/%d', '%m/%d/%Y', '%d.%m.%Y'")),
    "fn_to_date": (lambda: s.to_date(F.col("t"), month_first=True, strict=True), _iso("'%m/%d/%Y'")),
    "fn_is_date": (lambda: s.is_date(F.col("t")),
                   "trim(coalesce(t, '')) = '' OR try_strptime(trim(t), "
                   "['%Y-%m-%d', '%d.%m.%Y', '%m/%d/%Y', '%Y%m%d']) IS NOT NULL"),
}

QUERIES = {name: _over(TEXTS, spark_side) for name, (spark_side, _) in _TEXT_CASES.items()}
QUERIES |= {name: _over(DATES, spark_side) for name, (spark_side, _) in _DATE_CASES.items()}
ORACLE = {name: _oracle(TEXTS, sql) for name, (_, sql) in _TEXT_CASES.items()}
ORACLE |= {name: _oracle(DATES, sql) for name, (_, sql) in _DATE_CASES.items()}

# Prices of 19 digits and more, nine of them decimals, over counts with three decimals; exact halves among them.
_WIDE = """
SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN l_linenumber = 1 THEN '-' ELSE '' END || CAST(l_orderkey AS STRING) || '1234567890123.'
    || lpad(CAST(l_partkey % 1000 AS STRING), 4, '0') || '99500' AS t,
  CASE WHEN l_suppkey % 11 = 0 THEN '0.000' WHEN l_suppkey % 11 = 1 THEN '1'
    ELSE CAST(l_suppkey % 11 AS STRING) || '.' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') END AS u
FROM {lineitem}
"""


def _wide_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_WIDE, lineitem=read(spark, sf_dir, "lineitem"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", s.unit_price(F.col("t"), F.col("u")).alias("result"))


QUERIES["fn_unit_price_wide"] = _wide_prices
ORACLE["fn_unit_price_wide"] = f"""WITH texts AS ({_WIDE.format(lineitem='lineitem')}),
  whole AS (SELECT *, CAST(replace(replace(t, '.', ''), '-', '') AS HUGEINT) * 100 AS p,
              CAST(CASE WHEN u = '1' THEN '1000' ELSE replace(u, '.', '') END AS HUGEINT) * 1000000 AS d FROM texts),
  cents AS (SELECT *, CASE WHEN d > 0 THEN CAST((2 * p + d) // (2 * d) AS VARCHAR) END AS c FROM whole)
SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN t LIKE '-%' THEN '-' ELSE '' END || left(c, length(c) - 2) || '.' || right(c, 2) AS result FROM cents"""
