"""Every query of the workload has SQL; a sample of them agrees with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload import explanation, landing, normalization, reconciliation, scalars, transformation

SF = "/root/testdata/sf0.001"
SAMPLE = ["transform_marc_repeated_keys", "transform_mbew", "validate_expected_actual_marc", "validate_by_plant",
          "preview_unmapped", "scan_dedup_header", "normalize_extract"]


WORKLOAD = [transformation, scalars, normalization, landing, reconciliation, explanation]


def test_contract_is_complete():
    assert set(WORKLOAD) <= set(contract.MODULES)
    for module in WORKLOAD:
        assert set(module.QUERIES) == set(module.ORACLE)
        assert set(module.QUERIES) <= set(contract.queries()) and set(module.ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(repr, result.fetchall()))
