"""Key balances merged extract by extract against one pass over all rows."""

import pytest

from siteshift.mapping import DEFAULT_MAPPING
from siteshift.operators import reconcile as r
from siteshift.plans.balances import balance_state

EXPECTED = [("1", "US29"), ("1", "US29"), ("2", "US29"), ("3", "US30"), (None, "US30"), ("4", None)]
ACTUAL = [("001", "us29 "), ("2", "US29"), ("2", "US29"), ("5", "US30"), (None, "US30"), (None, None)]


def table(spark, rows):
    return spark.createDataFrame(list(rows), "PRODUCT string, WERKS string")


@pytest.mark.parametrize("by_plant", [False, True])
def test_merged_extracts_equal_one_pass(spark, tmp_path, by_plant):
    state = balance_state(spark, f"{tmp_path}/state", "MARC")
    for i in range(3):  # keys lie in several extracts, the last has no actual rows
        state.merge(f"e{i}", table(spark, EXPECTED[i::3]), table(spark, ACTUAL[i::2] if i < 2 else []))
    whole = r.key_balance("MARC", table(spark, EXPECTED), table(spark, ACTUAL), DEFAULT_MAPPING["MARC"], by_plant)
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, state.balance(by_plant).collect())) == want
    small = state.compacted(f"{tmp_path}/small")
    assert sorted(map(str, small.balance(by_plant).collect())) == want
    assert small.rows().count() == small.rows().select("plant", "key").distinct().count() < state.rows().count()


def test_an_extract_merged_again_replaces_itself(spark, tmp_path):
    state = balance_state(spark, f"{tmp_path}/state/", "MARC")
    for rows in (EXPECTED, EXPECTED, EXPECTED[:2]):
        state.merge("first", table(spark, rows), table(spark, ACTUAL))
    assert state.balance().first()["n_expected"] == 2
    assert state.record_count().first()["status"] == "fail"


def test_state_before_the_first_merge_and_wrong_names(spark, tmp_path):
    state = balance_state(spark, f"{tmp_path}/none", "MBEW")
    assert state.rows().count() == 0 and state.balance().first()["expected_keys"] == 0
    assert state.balance(by_plant=True).count() == 0
    state = balance_state(spark, f"{tmp_path}/none", "MARC")
    for name in ("", "a/b", "..", "a=b"):
        with pytest.raises(ValueError):
            state.merge(name, table(spark, EXPECTED), table(spark, ACTUAL))
