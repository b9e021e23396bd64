"""Edge values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from siteshift.functions import scalars as s


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)],
                                 "i int, a string, b string" if isinstance(inputs[0], tuple) else "i int, a string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


CASES = [
    (s.clean_cell, {" 40.0 ": "40", "40.05": "40.05", "\t": None, "-7.00": "-7", "40.000": "40", " x ": "x"}),
    (s.num, {"1d": None, "1,000": None, "nan": None, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "1_000": None, "": None}),
    (lambda c: s.fmt_num(s.num(c)), {"inf": None, "0.0000004": "0", "100": "100", "2.50": "2.5", "-3": "-3"}),
    (s.parse_date, {"2024-01-05T00:00": "2024-01-05", "20240105": "2024-01-05", "2024/01/05": "2024-01-05",
                    "1/5/2024": "2024-01-05", "05.01.2024": "2024-01-05", "13/01/2024": None, "2024-02-30": None,
                    "0000-01-01": None, "00000000": None, "2024-1-5": None}),
    (s.strip_zeros, {"000": "", "00120": "120"}),
    (s.is_number, {"1,000": True, "1_000": True, "nan": True, "x": False, "": True, ",": False, "1__0": False, "1e3": True}),
    (s.is_date, {"2024-1-5": True, "5.1.2024": True, "1/5/2024": True, "20240105": True, "2024115": True,
                 "2024-02-30": False, "31-31-2024": False, "": True}),
    (s.material_key, {" 00012.0": "12", "0": "", "A1": "A1"}),
]


@pytest.mark.parametrize("function, expected", CASES)
def test_scalar(spark, function, expected):
    assert values(spark, function(F.col("a")), list(expected)) == list(expected.values())


def test_unit_price(spark):
    pairs = {("10.05", "2"): "5.03", ("10", "0"): None, ("10", None): None, ("x", "2"): None, ("-10.05", "2"): "-5.03",
             ("1e2", "3"): "33.33", ("0.005", "1"): "0.01", ("1.0049999", "1"): "1.00", ("123456789012345.005", "1"): "123456789012345.01",
             ("1_000", "2"): "500.00", ("-0.001", "1"): "-0.00", ("-1", "-3"): "0.33", ("1e-40", "3"): "0.00", ("5", "0.000"): None,
             (" 7 ", "1e-2"): "700.00", (None, "1"): None, ("", "1"): None, ("1,5", "1"): None, ("0.0250", "-5"): "-0.01"}
    assert values(spark, s.unit_price(F.col("a"), F.col("b")), list(pairs)) == list(pairs.values())


def test_same(spark):
    pairs = {("1", "1.0"): True, (None, None): True, (None, "1"): False, ("a", "b"): False, ("nan", "NaN"): False,
             ("1_0", "10"): True}
    assert values(spark, s.same(F.col("a"), F.col("b")), list(pairs)) == list(pairs.values())


def test_null_conditions_are_false(spark):
    assert values(spark, s.ne(F.col("a"), "x"), [None, "x", "y"]) == [False, False, True]
    assert values(spark, s.not_in(F.col("a"), ["x"]), [None, "x", "y"]) == [False, False, True]
    assert values(spark, s.case([(F.col("a") == "x", "hit")], None), [None, "x", "y"]) == [None, "hit", None]


def test_only_cells_with_blank_or_foreign_ends_are_searched(spark):
    """Trimming by a list of characters stands behind a test of the ends; results are those of the trimming alone."""
    ends = ["", *s.WHITESPACE, "\x7f", "é", "\u200b", "!", "~", "0", "\u2003x"]
    cells = [a + b + c for a in ends for b in ("", "x", "a b", "é", "\u3000") for c in ends] + [None]
    df = spark.createDataFrame([(x,) for x in cells], "c string")
    plain = F.btrim(F.col("c"), F.lit(s.WHITESPACE))
    spaces = df.withColumn("_spaces", F.lit(s.WHITESPACE))
    got = spaces.select(s.strip(F.col("c")).eqNullSafe(plain).alias("a"), s.blank_to_null(F.col("c")).eqNullSafe(F.nullif(plain, F.lit(""))).alias("b"),
                        F.expr(s.blank_to_null_sql("c", "_spaces")).eqNullSafe(F.nullif(plain, F.lit(""))).alias("c"))
    assert got.filter("NOT (a AND b AND c)").count() == 0
    optimized = df.select(s.strip(F.col("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.index("CASE WHEN") < optimized.index("trim(")


def test_short_decimals_are_not_formatted(spark):
    texts = ["0", "-0.0", "27.5", "0.125", "0.000001", "0.0000005", "0.001", "-0.0015", "9999999.5", "10000000", "12345678.25", "1e20", "0.1234567",
             "40.25", "1e-7", "100", "0.0009", "1234567.123456", "1234567.1234565", "nan", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").try_cast("double").alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    formatted = F.when(finite, F.rtrim(F.rtrim(F.format_string("%.6f", "x"), F.lit("0")), F.lit(".")))
    assert df.filter(~s.fmt_num(F.col("x")).eqNullSafe(formatted)).count() == 0
    optimized = df.select(s.fmt_num(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.index("substring_index") < optimized.index("format_string")
