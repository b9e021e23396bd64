"""Hand-written SQL of the transformation: plant derivation, joins and field rules.

Written straight from the rule book with plain joins and one DISTINCT, so it does not share
the engine's plan (no pre-aggregated keys, no single/repeated split).
"""

from __future__ import annotations

from siteshift.layouts import MARC_BLANK, MARC_PASS, MARC_TARGET, MBEW_PASS, MBEW_TARGET
from workload.extracts import ctes, with_sql


def num_sql(c: str) -> str:
    return f"TRY_CAST({c} AS DOUBLE)"


def fmt_sql(x: str) -> str:
    return f"rtrim(rtrim(printf('%.6f', {x}), '0'), '.')"


def date_sql(c: str) -> str:
    def checked(iso: str) -> str:
        return f"CAST(TRY_CAST({iso} AS DATE) AS VARCHAR)"

    t = f"trim({c})"
    return f"""CASE
  WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T].*)?$') THEN {checked(f"substr({t}, 1, 10)")}
  WHEN regexp_matches({t}, '^[0-9]{{8}}$')
    THEN {checked(f"substr({t}, 1, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2)")}
  WHEN regexp_matches({t}, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') THEN {checked(f"replace({t}, '/', '-')")}
  WHEN regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$')
    THEN {checked(f"split_part({t}, '/', 3) || '-' || lpad(split_part({t}, '/', 1), 2, '0') || '-' || lpad(split_part({t}, '/', 2), 2, '0')")}
  WHEN regexp_matches({t}, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}$')
    THEN {checked(f"substr({t}, 7, 4) || '-' || substr({t}, 4, 2) || '-' || substr({t}, 1, 2)")}
END"""


def price_sql(price: str, units: str) -> str:
    """HALF_UP in integers: cents and whole units."""
    cents = f"CAST(CAST({price} AS DECIMAL(15, 2)) * 100 AS BIGINT)"
    u = f"CAST({units} AS BIGINT)"
    q = f"((2 * {cents} + {u}) // (2 * {u}))"
    return (f"CASE WHEN {price} IS NULL OR {units} IS NULL OR {u} = 0 THEN NULL "
            f"ELSE CAST({q} // 100 AS VARCHAR) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') END")


DERIVED = """
SELECT DISTINCT m.MATNR, m.WERKS AS src, side.dw
FROM marc m
JOIN (SELECT DISTINCT MATNR FROM mara WHERE LVORM IS NULL AND MTART <> 'NVAL') ok
  ON m.MATNR IS NOT DISTINCT FROM ok.MATNR
JOIN (VALUES ('1021', 'US30', 'US27'), ('1028', 'US31', 'US28'), ('1030', 'US33', 'US32')) p(plant, x, y)
  ON m.WERKS = p.plant
CROSS JOIN LATERAL (
  SELECT CASE WHEN SFCPF = 'DAP3' THEN x WHEN BESKZ = 'F' THEN x WHEN BESKZ IN ('E', 'X') THEN x
              WHEN BESKZ IS NULL THEN x ELSE WERKS END AS dw
  UNION ALL
  SELECT CASE WHEN SFCPF = 'DAP3' THEN x WHEN BESKZ = 'F' AND SOBSL IS NULL THEN y WHEN BESKZ = 'F' THEN x
              WHEN BESKZ IN ('E', 'X') THEN y WHEN BESKZ IS NULL THEN y ELSE WERKS END AS dw) side
WHERE m.LVORM IS NULL AND side.dw <> m.WERKS
"""


def targets_sql(table: str, plant: str) -> str:
    return f"""
SELECT r.*, b.dw FROM {table} r JOIN derived b ON r.MATNR IS NOT DISTINCT FROM b.MATNR AND r.{plant} = b.src
WHERE r.LVORM IS NULL
UNION ALL
SELECT r.*, CASE r.{plant} WHEN '1025' THEN 'US29' WHEN '1000' THEN 'US26' ELSE 'CA02' END AS dw
FROM {table} r WHERE r.LVORM IS NULL AND r.{plant} IN ('1025', '1000', '1029')
"""


EA = """
SELECT MATNR, UMREN AS um FROM (
  SELECT *, row_number() OVER (PARTITION BY MATNR ORDER BY _row_id) AS rn FROM marm WHERE MEINH = 'EA') e
WHERE rn = 1
"""

_CONTEXT = """
SELECT t.*, a.MTART AS mt, a.MEINS AS me, a.PRDHA AS ph, ea.um{extra}
FROM {targets} t
LEFT JOIN mara a ON t.MATNR IS NOT DISTINCT FROM a.MATNR
LEFT JOIN ea ON t.MATNR IS NOT DISTINCT FROM ea.MATNR{joins}
WHERE a.MTART IS DISTINCT FROM 'NVAL' AND a.LVORM IS NULL
"""
MARC_CONTEXT = _CONTEXT.format(
    extra=", g.EKGRP AS ek", targets="marc_targets",
    joins="""
LEFT JOIN (SELECT DISTINCT regexp_replace(MATNR, '^0+', '') AS k, WERKS, EKGRP FROM ekgrp) g
  ON regexp_replace(t.MATNR, '^0+', '') IS NOT DISTINCT FROM g.k AND t.WERKS = g.WERKS""")
MBEW_CONTEXT = _CONTEXT.format(extra="", targets="mbew_targets", joins="") + """
  AND t.MATNR IN (SELECT MATNR FROM mara WHERE LVORM IS NULL AND MTART <> 'UNBW')
"""

_DAP = "dw IN ('US30', 'US31', 'US33', 'CA02')"
_UM = "um"
_PRODUCED = "mt IN ('FERT', 'HALB')"


def _fert(value: str) -> str:
    return f"CASE WHEN mt = 'FERT' THEN '{value}' ELSE '' END"


def _scaled(c: str) -> str:
    return f"CASE WHEN {num_sql(c)} * {num_sql('um')} IS NULL THEN NULL ELSE {fmt_sql(f'{num_sql(c)} * {num_sql(_UM)}')} END"


def _lot(c: str) -> str:
    return (f"CASE WHEN {_PRODUCED} AND {_DAP} AND (SFCPF = 'DAP3' OR SOBSL = '30') THEN {_scaled(c)} "
            f"WHEN {_PRODUCED} AND {_DAP} THEN '0' WHEN me = 'CS' THEN {_scaled(c)} ELSE {c} END")


def _unit(c: str) -> str:
    return f"CASE WHEN {_DAP} THEN '' WHEN mt = 'FERT' AND BESKZ = 'E' THEN 'CS' ELSE {c} END"


MARC_RULES = {
    "PRODUCT": "MATNR",
    "WERKS": "dw",
    "MTVFP": "CASE WHEN mt = 'LEIH' THEN '02' WHEN dw IN ('US30', 'US31', 'US33') THEN 'SP' ELSE '02' END",
    "MMSTA": "CASE MMSTA WHEN '01' THEN 'PW' WHEN '02' THEN 'TB' WHEN 'BP' THEN 'BP' WHEN 'ZP' THEN 'ZP' "
             "WHEN 'BR' THEN 'BR' ELSE MMSTA END",
    "MMSTD": date_sql("MMSTD"),
    "KOKRS": "'CG01'",
    "AUSME": _unit("AUSME"),
    "EKGRP": "coalesce(ek, '')",
    "STRGR": _fert("40"),
    "FXHOR": "CASE WHEN mt = 'FERT' THEN '14' WHEN DISMM = 'P1' THEN '14' ELSE '' END",
    "VRMOD": _fert("2"),
    "VINT1": _fert("30"),
    "VINT2": _fert("7"),
    "BSTMI": _lot("BSTMI"),
    "BSTMA": _lot("BSTMA"),
    "BSTFE": _lot("BSTFE"),
    "BSTRF": _lot("BSTRF"),
    "WAERS": f"CASE WHEN {num_sql('LOSFX')} = 0 THEN '' ELSE 'USD' END",
    "AUSDT": date_sql("AUSDT"),
    "NFMAT": "regexp_replace(NFMAT, '^0+', '')",
    "BESKZ": "CASE WHEN BESKZ = 'E' AND dw IN ('US30', 'US31', 'US33') THEN 'F' ELSE BESKZ END",
    "SOBSL": "CASE WHEN dw = 'US30' AND BESKZ = 'F' AND SOBSL = '40' THEN '64' "
             "WHEN dw = 'US30' AND BESKZ = 'F' AND SOBSL = '41' THEN '67' "
             "WHEN dw = 'US30' AND BESKZ = 'F' AND SOBSL = '42' THEN '6A' "
             "WHEN dw = 'US30' AND BESKZ = 'E' THEN '62' ELSE SOBSL END",
    "LGPRO": "CASE dw WHEN 'US30' THEN '' WHEN 'US27' THEN 'PL01' ELSE LGPRO END",
    "LGFSB": "CASE dw WHEN 'US30' THEN 'DWHS' WHEN 'US27' THEN '' ELSE LGPRO END",
    "PERKZ": _fert("W"),
    "FRTME": _unit("FRTME"),
    "FEVOR": f"CASE WHEN {_DAP} THEN '' WHEN SFCPF = 'DAP1' THEN '001' WHEN SFCPF = 'DAP2' THEN '002' "
             "WHEN SFCPF = 'DAP3' THEN '003' ELSE FEVOR END",
    "SFCPF": f"CASE WHEN {_DAP} AND SFCPF <> 'DAP3' THEN '' WHEN SOBSL = '30' THEN '' ELSE SFCPF END",
    "AWSLS": f"CASE WHEN {num_sql('LOSGR')} = 0 THEN '' WHEN {_PRODUCED} THEN '000001' "
             "WHEN AWSLS = 'Z00001' THEN '000001' ELSE AWSLS END",
    "LOSGR": f"CASE WHEN {num_sql('LOSGR')} = 0 THEN '' WHEN mt = 'FERT' AND me = 'CS' THEN {_scaled('LOSGR')} "
             f"WHEN {num_sql('LOSGR')} IS NULL THEN NULL ELSE {fmt_sql(num_sql('LOSGR'))} END",
}

MBEW_RULES = {
    "PRODUCT": "MATNR",
    "BWKEY": "dw",
    "BWTAR": "CASE WHEN BWTAR = '~' THEN '' ELSE BWTAR END",
    "BKLAS": "CASE WHEN ph IN ('009990099900000999', '00999') THEN 'RACK' ELSE mt END",
    "EKLAS": "CASE WHEN mt = 'FERT' THEN 'YSIT' END",
    "WAERS": "'USD'",
    "VERPR": "''",
    "STPRS": f"CASE WHEN mt = 'FERT' AND me = 'CS' THEN {price_sql('STPRS', 'um')} ELSE STPRS END",
    "ZPLP1": "CASE WHEN mt NOT IN ('FERT', 'HALB') THEN STPRS ELSE '' END",
    "ZPLD1": "CASE WHEN mt NOT IN ('FERT', 'HALB') THEN STPRS ELSE '' END",
    "ZPLD2": date_sql("ZPLD2"),
    "ZPLD3": date_sql("ZPLD3"),
    "OWPNR": "''",
    "HKMAT": "'X'",
    "EKALR": "'X'",
    "KOSGR": f"CASE WHEN {_DAP} THEN '' ELSE KOSGR END",
    "PSTATB": "''",
    "PSTATG": "''",
}


def context_ctes(every_line: bool = True) -> list[tuple[str, str]]:
    return ctes(every_line) + [
        ("derived", DERIVED),
        ("ea", EA),
        ("marc_targets", targets_sql("marc", "WERKS")),
        ("mbew_targets", targets_sql("mbew", "BWKEY")),
        ("marc_d", MARC_CONTEXT),
        ("mbew_d", MBEW_CONTEXT),
    ]


def fields_sql(sheet: str, fields: list[str] | None = None) -> str:
    """SELECT DISTINCT of target fields over the joined rows."""
    if sheet == "MARC":
        rules = {**{c: c for c in MARC_PASS}, **{c: "''" for c in MARC_BLANK}, **MARC_RULES}
        fields = fields or MARC_TARGET
    else:
        rules = {**{c: c for c in MBEW_PASS}, **MBEW_RULES}
        fields = fields or MBEW_TARGET
    return f"SELECT DISTINCT {', '.join(f'{rules[f]} AS {f}' for f in fields)} FROM {sheet.lower()}_d"


def transform_sql(sheet: str, fields: list[str] | None = None, every_line: bool = True) -> str:
    return with_sql(context_ctes(every_line), fields_sql(sheet, fields))


_FAULT = "TRY_CAST(PRODUCT AS BIGINT) % 41"


def _faults_sql(sheet: str) -> str:
    columns = MARC_TARGET if sheet == "MARC" else MBEW_TARGET
    blanked, dated = ("DISMM", "MMSTD") if sheet == "MARC" else ("BKLAS", "ZPLD2")
    changed = {
        "PRODUCT": f"CASE WHEN {_FAULT} = 2 THEN lpad(PRODUCT, 18, '0') WHEN is_extra THEN '9' || PRODUCT ELSE PRODUCT END AS PRODUCT",
        blanked: f"CASE WHEN {_FAULT} = 3 THEN ' ' ELSE {blanked} END AS {blanked}",
        dated: f"CASE WHEN {_FAULT} = 4 THEN '31-31-2024' ELSE {dated} END AS {dated}",
    }
    if sheet == "MARC":
        changed["LGPRO"] = f"CASE WHEN {_FAULT} = 5 THEN 'TOOLONG' ELSE LGPRO END AS LGPRO"
    name = f"{sheet.lower()}_expected"
    return f"""
SELECT {', '.join(changed.get(c, c) for c in columns)} FROM (
  SELECT *, false AS is_extra FROM {name} WHERE {_FAULT} <> 0
  UNION ALL SELECT *, false AS is_extra FROM {name} WHERE {_FAULT} = 1
  UNION ALL SELECT *, true AS is_extra FROM {name} WHERE {_FAULT} = 6) f
"""


def target_ctes(sheet: str) -> list[tuple[str, str]]:
    """Source, expected and actual blocks of a sheet (``expected`` and ``actual`` as names)."""
    low = sheet.lower()
    return context_ctes() + [
        (f"{low}_expected", fields_sql(sheet)),
        ("expected", f"SELECT * FROM {low}_expected"),
        ("actual", _faults_sql(sheet)),
    ]
