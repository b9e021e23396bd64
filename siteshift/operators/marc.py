"""Plant-data field rules: target MARC columns as expressions over a joined source row.

A joined row has the source MARC columns plus the key context: ``_target`` (derived plant),
``_mtart``, ``_meins``, ``_umren`` and ``_ekgrp``, and the quantities read ``with_numbers``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteshift.functions.scalars import case, fmt_num, ne, num, strip_zeros, to_date
from siteshift.layouts import DAP_PLANTS, MARC_BLANK, MARC_PASS, MARC_TARGET, SP_PLANTS


def _fert() -> Column:
    return F.col("_mtart") == "FERT"


def _for_fert(value: str) -> Column:
    return case([(_fert(), value)], "")


def _produced() -> Column:
    return F.col("_mtart").isin("FERT", "HALB")


def _at_dap() -> Column:
    return F.col("_target").isin(*DAP_PLANTS)


QUANTITIES = ["LOSGR", "BSTMI", "BSTMA", "BSTFE", "BSTRF"]


def with_numbers(joined: DataFrame) -> DataFrame:
    """Joined rows with their quantities as numbers (``_n_``) and as converted text (``_x_``).

    Each is read once, in projections of their own: within the branches of a rule every mention would be one more reading.
    """
    numbers = joined.withColumns({f"_n_{f}": num(F.col(f)) for f in [*QUANTITIES, "LOSFX", "_umren"]})
    texts = {f"_x_{f}": fmt_num(F.col(f"_n_{f}") * F.col("_n__umren")) for f in QUANTITIES}
    return numbers.withColumns({**texts, "_lot": fmt_num(F.col("_n_LOSGR"))})


def scaled(column: str) -> Column:
    """Quantity converted by the material's EA denominator; NULL when either is no number."""
    return F.col(f"_x_{column}")


def lot_size(column: str) -> Column:
    at_dap = _produced() & _at_dap()
    kept_by_dap = (F.col("SFCPF") == "DAP3") | (F.col("SOBSL") == "30")
    return case(
        [(at_dap & kept_by_dap, scaled(column)), (at_dap, "0"), (F.col("_meins") == "CS", scaled(column))],
        F.col(column),
    )


def _unit(column: str) -> Column:
    return case([(_at_dap(), ""), (_fert() & (F.col("BESKZ") == "E"), "CS")], F.col(column))


def _special_procurement() -> Column:
    us30 = F.col("_target") == "US30"
    bought = us30 & (F.col("BESKZ") == "F")
    sobsl = F.col("SOBSL")
    return case(
        [(bought & (sobsl == "40"), "64"), (bought & (sobsl == "41"), "67"), (bought & (sobsl == "42"), "6A"),
         (us30 & (F.col("BESKZ") == "E"), "62")],
        sobsl,
    )


@lru_cache
def derived_fields() -> dict[str, Column]:
    c = F.col
    target, sfcpf = c("_target"), c("SFCPF")
    no_lot = c("_n_LOSGR") == 0
    rules = {
        "PRODUCT": c("MATNR"),
        "WERKS": target,
        "MTVFP": case([(c("_mtart") == "LEIH", "02"), (target.isin(*SP_PLANTS), "SP")], "02"),
        "MMSTA": case([(c("MMSTA") == "01", "PW"), (c("MMSTA") == "02", "TB")], c("MMSTA")),
        "MMSTD": to_date(c("MMSTD")),
        "KOKRS": F.lit("CG01"),
        "AUSME": _unit("AUSME"),
        "EKGRP": F.coalesce(c("_ekgrp"), F.lit("")),
        "STRGR": _for_fert("40"),
        "FXHOR": case([(_fert() | (c("DISMM") == "P1"), "14")], ""),
        "VRMOD": _for_fert("2"),
        "VINT1": _for_fert("30"),
        "VINT2": _for_fert("7"),
        "WAERS": case([(c("_n_LOSFX") == 0, "")], "USD"),
        "AUSDT": to_date(c("AUSDT")),
        "NFMAT": strip_zeros(c("NFMAT")),
        "BESKZ": case([((c("BESKZ") == "E") & target.isin(*SP_PLANTS), "F")], c("BESKZ")),
        "SOBSL": _special_procurement(),
        "LGPRO": case([(target == "US30", ""), (target == "US27", "PL01")], c("LGPRO")),
        # the rule book falls back to LGPRO here, not to LGFSB
        "LGFSB": case([(target == "US30", "DWHS"), (target == "US27", "")], c("LGPRO")),
        "PERKZ": _for_fert("W"),
        "FRTME": _unit("FRTME"),
        "FEVOR": case([(_at_dap(), ""), (sfcpf == "DAP1", "001"), (sfcpf == "DAP2", "002"),
                       (sfcpf == "DAP3", "003")], c("FEVOR")),
        "SFCPF": case([(_at_dap() & ne(sfcpf, "DAP3"), ""), (c("SOBSL") == "30", "")], sfcpf),
        # tested on LOSGR, as the rule book has it
        "AWSLS": case([(no_lot, ""), (_produced() | (c("AWSLS") == "Z00001"), "000001")], c("AWSLS")),
        "LOSGR": case([(no_lot, ""), (_fert() & (c("_meins") == "CS"), scaled("LOSGR"))],
                      c("_lot")),
    }
    rules.update({f: lot_size(f) for f in ("BSTMI", "BSTMA", "BSTFE", "BSTRF")})
    return rules


#: Target columns with one value in every row.
CONSTANT = ["KOKRS", *MARC_BLANK]


def target_rules() -> dict[str, Column]:
    """Rule of every target column, in target order."""
    rules = dict(derived_fields())
    rules.update({f: F.col(f) for f in MARC_PASS})
    rules.update({f: F.lit("") for f in MARC_BLANK})
    return {f: rules[f] for f in MARC_TARGET}
