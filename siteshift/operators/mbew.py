"""Valuation field rules: target MBEW columns as expressions over a joined source row."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteshift.functions.scalars import case, not_in, to_date, unit_price
from siteshift.layouts import DAP_PLANTS, MBEW_PASS, MBEW_TARGET, RACK_HIERARCHIES


@lru_cache
def derived_fields(strict_dates: bool = False) -> dict[str, Column]:
    c = F.col
    by_case = (c("_mtart") == "FERT") & (c("_meins") == "CS")
    # the rule book puts the price in the date field ZPLD1 too
    planned = case([(not_in(c("_mtart"), ["FERT", "HALB"]), c("STPRS"))], "")
    return {
        "PRODUCT": c("MATNR"),
        "BWKEY": c("_target"),
        "BWTAR": case([(c("BWTAR") == "~", "")], c("BWTAR")),
        "BKLAS": case([(c("_prdha").isin(*RACK_HIERARCHIES), "RACK")], c("_mtart")),
        "EKLAS": case([(c("_mtart") == "FERT", "YSIT")], None),
        "WAERS": F.lit("USD"),
        "VERPR": F.lit(""),
        "STPRS": case([(by_case, unit_price(c("STPRS"), c("_umren")))], c("STPRS")),
        "ZPLP1": planned,
        "ZPLD1": planned,
        "ZPLD2": to_date(c("ZPLD2"), month_first=True, strict=strict_dates),
        "ZPLD3": to_date(c("ZPLD3"), month_first=True, strict=strict_dates),
        "OWPNR": F.lit(""),
        "HKMAT": F.lit("X"),
        "EKALR": F.lit("X"),
        "KOSGR": case([(c("_target").isin(*DAP_PLANTS), "")], c("KOSGR")),
        "PSTATB": F.lit(""),
        "PSTATG": F.lit(""),
    }


#: Target columns with one value in every row.
CONSTANT = "WAERS VERPR OWPNR HKMAT EKALR PSTATB PSTATG".split()


def target_rules(strict_dates: bool = False) -> dict[str, Column]:
    """Rule of every target column, in target order."""
    rules = dict(derived_fields(strict_dates))
    rules.update({f: F.col(f) for f in MBEW_PASS})
    return {f: rules[f] for f in MBEW_TARGET}
