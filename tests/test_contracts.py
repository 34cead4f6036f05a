import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import contracts as C


def test_valid_table_passes(customers):
    C.check_contract(customers({}, {}))


def test_absent_column_is_named(customers):
    with pytest.raises(C.ContractError, match="monthly_spend"):
        C.check_contract(customers({}).drop("monthly_spend"))


def test_label_is_optional_when_scoring(customers):
    C.check_contract(customers({}).drop(S.LABEL), require_label=False)
    with pytest.raises(C.ContractError):
        C.check_contract(customers({}).drop(S.LABEL))


def test_repeated_and_missing_keys(customers):
    with pytest.raises(C.ContractError, match="not unique"):
        C.check_contract(customers({"customer_id": "x"}, {"customer_id": "x"}))
    assert C.repeated_keys(customers({"customer_id": None}, {"customer_id": None})).count() == 1


def test_labels_must_be_binary_even_when_scoring(customers):
    table = customers({"churned": 2}, {"churned": None}, {"churned": 1})
    assert [r[0] for r in C.foreign_labels(table).collect()] == [2]
    with pytest.raises(C.ContractError, match="0 or 1"):
        C.check_contract(table, require_label=False)


def test_row_violations(customers):
    table = customers({}, {"region": None, "account_age_days": -3}, {"monthly_spend": None}, {"pages_per_session": -1.0})
    valid, quarantined = C.split_valid(table)
    assert valid.count() == 2
    found = {r[S.ID]: r["violations"] for r in quarantined.collect()}
    assert found["c1"] == ["region is missing", "account_age_days is negative"]
    assert found["c3"] == ["pages_per_session is negative"]


def test_quality_counts(customers, spark):
    table = customers({"account_age_days": -1}, {"days_since_last_login": 999}, {"monthly_spend": None})
    counts = {r["column"]: (r["missing"], r["invalid_range"]) for r in C.quality_counts(table).collect()}
    assert counts["account_age_days"] == (0, 1)
    assert counts["days_since_last_login"] == (0, 1)
    assert counts["monthly_spend"] == (1, 0)
    absent = C.quality_counts(table.drop("region"))
    assert {r["column"]: r["missing"] for r in absent.collect()}["region"] == 3


def test_unparsable_text_is_neither_missing_nor_out_of_range(customers):
    table = customers({}, {}).withColumn("monthly_spend", F.col("region"))
    counts = {r["column"]: (r["missing"], r["invalid_range"]) for r in C.quality_counts(table).collect()}
    assert counts["monthly_spend"] == (0, 0)


def test_modelling_columns_keep_id_and_label(customers):
    table = C.modelling_columns(customers({}))
    assert table.columns[:2] == [S.ID, S.LABEL] and table.schema[S.LABEL].dataType.simpleString() == "int"


def test_column_contract_counts_rows(customers):
    table = customers({"monthly_spend": float("nan")}, {"monthly_spend": None, "region": None}, {}).drop("churned")
    found = {r["column"]: r for r in C.column_contract(table).collect()}
    assert (found["monthly_spend"]["missing"], found["region"]["missing"], found["customer_id"]["missing"]) == (2, 1, 0)
    absent = found["churned"]
    assert (absent["present"], absent["type"], absent["n_rows"], absent["missing"]) == (False, None, 3, 3)
