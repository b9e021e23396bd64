"""Scalar building blocks: text, number, date and price rules as Column expressions.

All of them are built-in JVM expressions. Casts are ``try_cast`` throughout: source
columns are free text and ANSI mode would otherwise fail a whole job on one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a Unicode-aware strip removes.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
KEY_SEPARATOR = "␟"

_NUMBER = r"(?i)^[ \t-\r]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)[ \t-\r]*$"
_FLOAT_DIGITS = (
    r"(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?|inf|infinity"
)
_FLOAT_VALUE = rf"(?i)^\s*[+-]?(?:{_FLOAT_DIGITS})\s*$"
_FLOAT_TEXT = rf"(?i)^\s*[+-]?(?:{_FLOAT_DIGITS}|nan)\s*$"
_PLAIN_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _bare(c: Column) -> Column:
    """ASCII text that begins and ends with a visible character: there is nothing to trim, and something is left.

    Trimming by a list of characters searches the whole list for both ends of every cell; these comparisons take less.
    """
    return (c >= "!") & (F.octet_length(c) == F.length(c)) & (F.substring(c, -1, 1) >= "!")


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace, not just blanks."""
    return F.when(_bare(c), c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    trimmed = F.btrim(c, F.lit(WHITESPACE))
    return F.when(_bare(c), c).otherwise(F.when(trimmed != "", trimmed))


def blank_to_null_sql(c: str, spaces: str) -> str:
    """``blank_to_null`` as SQL text, for expressions of hundreds of fields; ``spaces`` names a column of WHITESPACE."""
    return (f"CASE WHEN {c} >= '!' AND octet_length({c}) = length({c}) AND substring({c}, -1, 1) >= '!' THEN {c} "
            f"WHEN btrim({c}, {spaces}) <> '' THEN btrim({c}, {spaces}) END")


def txt(c: Column) -> Column:
    """Trimmed text with NULL as the empty text."""
    return strip(F.coalesce(c, F.lit("")))


def is_blank(c: Column) -> Column:
    return txt(c) == ""


def float_int(c: Column) -> Column:
    """``40.0`` -> ``40``. The suffix test keeps the pattern off almost every cell."""
    return F.when(c.endswith("0") & c.contains("."),
                  F.regexp_replace(c, r"^(-?[0-9]+)\.0+$", "$1")).otherwise(c)


def clean_cell(c: Column) -> Column:
    return float_int(blank_to_null(c))


def strip_zeros(c: Column) -> Column:
    """Leading zeros dropped; ``000`` becomes the empty text, not NULL."""
    return F.ltrim(c, F.lit("0"))


def ne(c: Column, value: str) -> Column:
    """SQL ``<>``: NULL is not different from anything."""
    return F.coalesce(c != value, F.lit(False))


def not_in(c: Column, values: Sequence[str]) -> Column:
    """SQL ``NOT IN`` over constants: NULL is never outside the list."""
    return F.coalesce(~c.isin(*values), F.lit(False))


def case(branches: Sequence[tuple[Column, Column | str | None]], default: Column | str | None) -> Column:
    """First branch whose condition is true wins; a NULL condition counts as false."""
    def value(v):
        return v if isinstance(v, Column) else text(v)

    (cond, first), *rest = branches
    out = F.when(cond, value(first))
    for cond, v in rest:
        out = out.when(cond, value(v))
    return out.otherwise(value(default))


def _may_be_number(c: Column) -> Column:
    """False for most text that is no number: one starts with a space, a sign, a digit, a point or ``inf``."""
    return (c < ":") | c.startswith("i") | c.startswith("I")


def num(c: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL (``1d``, ``1,000``, ``nan``)."""
    return F.when(_may_be_number(c) & c.rlike(_NUMBER), c.try_cast("double"))


def float_value(c: Column) -> Column:
    """Double value in the wider float notation (``1_000``); ``nan`` equals nothing, so NULL."""
    return F.when(_may_be_number(c) & c.rlike(_FLOAT_VALUE), F.replace(strip(c), F.lit("_"), F.lit("")).try_cast("double"))


def fmt_num(x: Column) -> Column:
    """Six decimals at most, plain notation, no trailing zeros; NaN and infinities are NULL."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shortest = x.cast("string")
    near = (x == 0) | ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7))  # written without an exponent
    # six decimals at most are what the format would give, at a fraction of its price
    plain = near & (F.length(F.substring_index(shortest, ".", -1)) <= 6)
    formatted = F.when(plain, shortest).when(finite, F.format_string("%.6f", x))
    return F.rtrim(F.rtrim(formatted, F.lit("0")), F.lit("."))


def _iso_or_null(iso: Column) -> Column:
    """Valid calendar day of an assembled ``y-m-d`` text as ISO text; year 0 does not exist."""
    return F.when(~iso.startswith("0000"), iso.try_cast("date").cast("string"))


def _joined(t: Column, *spans: tuple[int, int]) -> Column:
    return F.concat_ws("-", *[F.substring(t, start, size) for start, size in spans])


_SLASH_MDY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def parse_date(c: Column) -> Column:
    """Five date layouts to ISO text. The layout that fits decides, so a bad day is NULL."""
    t = strip(c)
    iso = (
        F.when(t.rlike(r"(?d)^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.substring(t, 1, 10))
        .when(t.rlike(r"^\d{8}$"), _joined(t, (1, 4), (5, 2), (7, 2)))
        .when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.translate(t, "/", "-"))
        .when(t.rlike(_SLASH_MDY), F.regexp_replace(t, _SLASH_MDY, "$3-$1-$2"))
        .when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), _joined(t, (7, 4), (4, 2), (1, 2)))
    )
    return _iso_or_null(iso)


def to_date(c: Column, month_first: bool = False, strict: bool = False) -> Column:
    """Date column to ISO text. ``month_first`` tries month/day/year before the other layouts;
    ``strict`` accepts nothing else."""
    if not month_first:
        return parse_date(c)
    t = strip(c)
    mdy = _iso_or_null(F.when(t.rlike(_SLASH_MDY), F.regexp_replace(t, _SLASH_MDY, "$3-$1-$2")))
    return mdy if strict else F.coalesce(mdy, parse_date(c))


#: Digits of an operand, brought to a common scale, that exact prices are worked out with.
PRICE_DIGITS = 36
#: Unsigned texts that fit decimal(20,6) as they are.
_SHORT_DECIMAL = r"^\d{1,14}(\.\d{0,6})?$"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once: a lambda over one element gives it a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _decimal_parts(c: Column) -> Column:
    """(minus, digits without leading zeros, scale) of a decimal text; NULL members for other text."""
    plain = F.replace(strip(c), F.lit("_"), F.lit(""))

    def split(t: Column) -> Column:
        mantissa = F.regexp_extract(t, r"^[+-]?([^eE]*)", 1)
        exponent = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE](.*)$", 1), F.lit("")), F.lit("0")).try_cast("int")
        fraction = F.length(F.regexp_extract(mantissa, r"\.(.*)$", 1))
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
        return F.struct(t.startswith("-").alias("minus"), digits.alias("digits"), (fraction - exponent).alias("scale"))

    return _bound(F.when(plain.rlike(_PLAIN_DECIMAL), plain), split)


def _exact_quotient(price: Column, units: Column) -> Column:
    def padded(x: Column, zeros: Column) -> Column:
        return F.concat(x["digits"], F.repeat(F.lit("0"), F.least(F.greatest(zeros, F.lit(0)), F.lit(400))))

    def scaled(x: Column) -> Column:
        shift = x["u"]["scale"] - x["p"]["scale"] + 2
        return F.struct(
            padded(x["p"], shift).alias("n"), padded(x["u"], -shift).alias("d"),
            (F.length(x["p"]["digits"]) == 0).alias("zero"), (F.length(x["u"]["digits"]) > 0).alias("divides"),
            F.when(x["p"]["minus"] != x["u"]["minus"], "-").otherwise("").alias("sign"))

    def whole(x: Column) -> Column:
        n, d = (x[c].try_cast("decimal(38,0)") for c in ("n", "d"))
        return _bound(F.struct((n * F.lit(2) + d).alias("n"), (d * F.lit(2)).alias("d")),
                      lambda y: ((y["n"] - y["n"] % y["d"]) / y["d"]).cast("decimal(38,0)").cast("string"))

    def text(x: Column) -> Column:
        n, d = F.length(x["n"]), F.length(x["d"])
        cents = (
            F.when(x["zero"] | (d > n + 1), "0")
            .when((n <= PRICE_DIGITS) & (d <= PRICE_DIGITS), whole(x))
            .otherwise(F.raise_error(F.concat(F.lit("price out of range: "), price, F.lit(" / "), units)))
        )
        shown = _bound(cents, lambda q: F.regexp_replace(F.when(F.length(q) < 3, F.lpad(q, 3, "0")).otherwise(q), r"(\d\d)$", ".$1"))
        return F.when(x["n"].isNotNull() & x["divides"], F.concat(x["sign"], shown))

    return _bound(_bound(F.struct(_decimal_parts(price).alias("p"), _decimal_parts(units).alias("u")), scaled), text)


def unit_price(price: Column, units: Column) -> Column:
    """Exact price / units, HALF_UP at two decimals, as text. Zero units, NULL or invalid is NULL.

    Short unsigned texts are decimals that lose nothing, and their 18-decimal quotient rounds as the exact one
    does. All others become integers of one scale, so no operand is ever rounded; the sign is the quotient's,
    also of a price that rounds to zero. A quotient that needs more than PRICE_DIGITS digits fails loudly.
    """
    p, u = strip(price), strip(units)
    short = F.round(F.try_divide(p.try_cast("decimal(20,6)"), u.try_cast("decimal(20,6)")), 2).cast("decimal(38,2)").cast("string")
    return F.when(p.rlike(_SHORT_DECIMAL) & u.rlike(_SHORT_DECIMAL), short).otherwise(_exact_quotient(price, units))


def round_binary(x: Column, digits: int) -> Column:
    """A non-negative double rounded on its exact binary value, ties to even, as the digits of floats are printed.

    Scaled by a power of two the value is an integer, so which side of a tie it lies on is decided without error.
    """
    def exact(bits: int) -> Column:
        unit = F.lit(str(2**bits)).cast("decimal(38,0)")
        scaled = (x * F.lit(float(2**bits))).cast("bigint").cast("decimal(38,0)") * F.lit(10**digits)
        rest = scaled % unit
        whole = ((scaled - rest) / unit).cast("decimal(38,0)")
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
        return (whole + up.cast("int")).cast("double") / 10**digits

    return F.when(x < 100.5, exact(56)).when(x < 2.0**17, exact(45)).otherwise(F.bround(x, digits))


def same(a: Column, b: Column) -> Column:
    """Equal as text (NULL equals NULL) or both numbers of the same value. Numbers are read where both sides have text."""
    return F.when(a.eqNullSafe(b), True).when(a.isNull() | b.isNull(), False).otherwise(
        F.coalesce(float_value(a) == float_value(b), F.lit(False)))


def is_number(c: Column) -> Column:
    """Blank, or a float once thousands commas are gone."""
    return is_blank(c) | F.coalesce(F.replace(strip(c), F.lit(","), F.lit("")).rlike(_FLOAT_TEXT), F.lit(False))


_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"


def is_date(c: Column) -> Column:
    """Blank, or a real day in one of four layouts; day and month need not be padded."""
    t = strip(c)
    layouts = [
        (rf"^(\d{{4}})-{_MONTH}-{_DAY}$", "$1-$2-$3"),
        (rf"^{_DAY}\.{_MONTH}\.(\d{{4}})$", "$3-$2-$1"),
        (rf"^{_MONTH}/{_DAY}/(\d{{4}})$", "$3-$1-$2"),
        (rf"^(\d{{4}}){_MONTH}{_DAY}$", "$1-$2-$3"),
    ]
    iso = F.lit(None).cast("string")
    for pattern, order in reversed(layouts):
        iso = F.when(t.rlike(pattern), F.translate(F.regexp_replace(t, pattern, order), " ", "")).otherwise(iso)
    return is_blank(c) | _iso_or_null(iso).isNotNull()


def too_long(c: Column, limit: int) -> Column:
    """Trimmed length beyond the limit; NULLs are not measured."""
    return F.coalesce(F.length(strip(c)) > limit, F.lit(False))


def material_key(c: Column) -> Column:
    """Material number as people type it: no float artefact, no leading zeros."""
    return strip_zeros(F.regexp_replace(strip(c), r"\.0+$", ""))


def plant_text(c: Column) -> Column:
    return F.upper(txt(c))


def match_key(parts: Sequence[tuple[str, Column]]) -> Column:
    """Composite comparison key of named parts; the product part ignores leading zeros."""
    cols = []
    for name, c in parts:
        part = F.upper(txt(c))
        cols.append(strip_zeros(part) if name == "PRODUCT" else part)
    return F.concat_ws(KEY_SEPARATOR, *cols)


def null_safe_key(c: Column) -> Column:
    """Injective, never-NULL image of a key.

    Blank keys have to meet each other in joins. Joining on this image keeps the join a plain
    equality, so grouping and joining by it share one hash partitioning.
    """
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def key_of(image: Column) -> Column:
    """The key that ``null_safe_key`` made the image of."""
    return F.when(image != "", F.substr(image, F.lit(2)))
