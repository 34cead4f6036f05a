import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import drift as D
from ebbtide.plans.drift_job import write_drift_report


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def brute_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = np.histogram(ref, edges)[0].astype(float), np.histogram(cur, edges)[0].astype(float)
    p, q = (r + 1e-6) / (r.sum() + 1e-6), (c + 1e-6) / (c.sum() + 1e-6)
    return float(np.sum((q - p) * np.log(q / p)))


def brute_ks(ref, cur):
    at = np.unique(np.r_[ref, cur])
    share = lambda x: np.searchsorted(np.sort(x), at, side="right") / len(x)
    return float(np.max(np.abs(share(ref) - share(cur))))


def test_identical_tables_do_not_drift(population):
    rows = D.feature_drift(population, population).collect()
    assert {r["feature"] for r in rows} == set(S.RAW_FEATURES)
    assert all(r["psi"] == 0.0 and r["band"] == "stable" for r in rows)
    assert all((r["ks"] is None) == (r["feature"] in S.CATEGORICAL) for r in rows)
    assert all(r["ks"] in (None, 0.0) for r in rows)


def test_numbers_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    ref = np.round(rng.normal(0, 1, 700), 2)
    cur = np.round(rng.normal(0.5, 1.4, 400), 2)
    ref[::3] = 0.1  # a third of the values are equal, so some deciles fall together
    a, b = column(spark, map(float, ref)), column(spark, map(float, cur))
    assert D.numeric_psi(a, b, "x").first()["psi"] == pytest.approx(brute_psi(ref, cur), abs=1e-9)
    for edges in ([], [-1.0, 0.1, 0.5]):
        assert D.ks_statistic(a, b, "x", edges).first()["ks"] == pytest.approx(brute_ks(ref, cur), abs=1e-12)


def test_bins_without_rows_count(spark):
    ref, cur = [float(i) for i in range(100)], [99.5] * 50
    assert D.numeric_psi(column(spark, ref), column(spark, cur), "x").first()["psi"] == pytest.approx(
        brute_psi(np.array(ref), np.array(cur)), abs=1e-6
    )


def test_empty_side(spark):
    full, empty = column(spark, [1.0, 2.0, 3.0]), column(spark, [None, None])
    for a, b in ((full, empty), (empty, full)):
        assert D.numeric_psi(a, b, "x").first()["psi"] == 0.0
        assert D.ks_statistic(a, b, "x").first()["ks"] == 0.0
    row = D.feature_drift(full, empty, ["x"], []).first()
    assert (row["psi"], row["ks"], row["cur_missing"]) == (0.0, 0.0, 1.0)


def test_missing_is_a_level_of_its_own(spark):
    a, b = column(spark, ["u", "u", "v", None], "string"), column(spark, ["u", None, None, "w"], "string")
    r, c = np.array([2, 1, 0, 1.0]), np.array([1, 0, 1, 2.0])
    p, q = (r + 1e-6) / (4 + 1e-6), (c + 1e-6) / (4 + 1e-6)
    assert D.categorical_psi(a, b, "x").first()["psi"] == pytest.approx(np.sum((q - p) * np.log(q / p)), abs=1e-9)


def test_few_values_are_compared_as_levels(spark):
    a, b = column(spark, [0.0] * 8 + [1.0] * 2), column(spark, [0.0] * 5 + [1.0] * 5)
    r, c = np.array([8, 2.0]), np.array([5, 5.0])
    p, q = (r + 1e-6) / (10 + 1e-6), (c + 1e-6) / (10 + 1e-6)
    expected = np.sum((q - p) * np.log(q / p))
    assert D.numeric_psi(a, b, "x").first()["psi"] == pytest.approx(expected, abs=1e-9)


def test_unparsable_text_is_dropped(spark):
    a, b = column(spark, ["1", "2", "3", "oops"], "string"), column(spark, ["1", "2", "3", None], "string")
    assert D.ks_statistic(a, b, "x").first()["ks"] == 0.0


def test_report_tables_are_written(spark, population, tmp_path):
    number = F.substring(S.ID, 3, 4).cast("int")
    halves = population.filter(number % 2 == 0), population.filter(number % 2 == 1)
    paths = write_drift_report(*halves, str(tmp_path / "report"), runs_folder=str(tmp_path / "no-runs"))
    assert set(paths) == {"row_counts", "quality", "feature_drift"}
    assert spark.read.parquet(paths["feature_drift"]).count() == len(S.RAW_FEATURES)
    assert {r["rows"] for r in spark.read.parquet(paths["row_counts"]).collect()} == {120}


def test_bins_are_found_before_rows_are_grouped(spark):
    from ebbtide.operators import drift

    ref = spark.range(2000).selectExpr("cast(id as double) as x")
    cur = spark.range(2000).selectExpr("cast(id * 1.1 as double) as x")
    alone = drift.numeric_psi(ref, cur, "x")
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature" in plan and "hashpartitioning(feature#" in plan
    assert not any("hashpartitioning" in line and "value#" in line for line in plan.split("\n"))
    both = {r["feature"]: r["psi"] for r in drift.feature_drift(ref, cur, ["x"], []).collect()}
    assert abs(alone.first()["psi"] - both["x"]) < 1e-9


def test_infinite_and_missing_values_drift_without_errors(spark):
    from ebbtide.operators import drift

    nan, inf = float("nan"), float("inf")
    ref = spark.createDataFrame([(float(v),) for v in range(40)] + [(nan,), (None,), (inf,), (-inf,)], "x double")
    cur = spark.createDataFrame([(float(v) / 2,) for v in range(40)] + [(nan,), (inf,), (inf,)], "x double")
    row = drift.feature_drift(ref, cur, ["x"], []).first()
    assert row["psi"] > 0 and 0 < row["ks"] < 1
    assert row["cur_missing"] == pytest.approx(1 / 43)
