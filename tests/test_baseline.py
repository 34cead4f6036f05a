import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import baseline as B
from ebbtide.operators import drift as D
from ebbtide.operators.contracts import ContractError
from ebbtide.plans import drift_job


def by_feature(frame):
    return {r["feature"]: r for r in frame.collect()}


def assert_same(got, want):
    got, want = by_feature(got), by_feature(want)
    assert set(got) == set(want)
    for feature, row in want.items():
        for name in ("psi", "ks", "cur_missing"):
            assert got[feature][name] == (None if row[name] is None else pytest.approx(row[name], abs=1e-9)), feature
        assert got[feature]["band"] == row["band"]


def days(population):
    number = F.substring(S.ID, 3, 4).cast("int")
    return [population.filter(number % 3 == i) for i in range(3)]


def test_merged_days_equal_the_two_tables(spark, population, tmp_path):
    first, second, today = days(population)
    path = str(tmp_path / "profile")
    drift_job.save_baseline(first, path)
    drift_job.save_baseline(second, path, mode="append")
    paths = drift_job.write_baseline_report(path, today, str(tmp_path / "report"))
    assert_same(spark.read.parquet(paths["feature_drift"]), D.feature_drift(first.unionByName(second), today))
    rows = {r["side"]: r["rows"] for r in spark.read.parquet(paths["row_counts"]).collect()}
    assert rows == {"ref": first.count() + second.count(), "cur": today.count()}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        drift_job.save_baseline(first, path)


def test_edges_are_the_deciles_of_the_rows(population):
    profile = B.profile_of(population)
    want = D.decile_edges(population, S.NUMERIC)
    for edges in ([], [1.0, 40.0, 300.0]):
        got = B.profile_edges(profile, edges=edges)
        assert set(got) == set(want)
        assert all(got[c] == pytest.approx(want[c]) for c in want)


def test_strange_values(spark):
    nan, inf = float("nan"), float("inf")
    schema = "x double, c string"
    ref = spark.createDataFrame(
        [(float(v % 40), "u") for v in range(90)] + [(nan, None), (None, "__MISSING__"), (inf, "v"), (-inf, "v")], schema
    )
    cur = spark.createDataFrame([(v / 2, "w") for v in range(40)] + [(nan, None), (inf, "u"), (-0.0, None)], schema)
    both = B.profile_drift(B.profile_of(ref, ["x"], ["c"]), B.profile_of(cur, ["x"], ["c"]))
    assert_same(both, D.feature_drift(ref, cur, ["x"], ["c"]))


def test_a_side_without_numbers(spark):
    full = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    empty = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    for a, b in ((full, empty), (empty, full), (empty, empty)):
        assert_same(B.profile_drift(B.profile_of(a, ["x"], []), B.profile_of(b, ["x"], [])), D.feature_drift(a, b, ["x"], []))


def test_a_merged_profile_is_the_profile_of_both(population):
    first, second, _ = days(population)
    together = B.merged(B.profile_of(first), B.profile_of(second))
    assert together.exceptAll(B.profile_of(first.unionByName(second))).count() == 0


def test_a_table_that_breaks_the_contract_is_no_reference(population, tmp_path):
    with pytest.raises(ContractError):
        drift_job.save_baseline(population.unionByName(population.limit(1)), str(tmp_path / "profile"))
