import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import campaign as C


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, map(float, scores))), "churned int, p double")


def brute_curve(labels, scores, cost, value, uplift):
    y, p = np.array(labels), np.array(scores)
    out = []
    for k in range(101):
        hit = p >= k * 0.01
        tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
        out.append(tp * uplift * value - (tp + fp) * cost)
    return out


def test_curve_equals_loop(spark):
    rng = np.random.default_rng(5)
    labels, scores = rng.integers(0, 2, 500).tolist(), np.round(rng.random(500), 3).tolist()
    rows = C.value_curve(C.grid_counts(scored(spark, labels, scores), "p"), 20.0, 200.0, 0.2).orderBy("step").collect()
    assert [r["ev"] for r in rows] == pytest.approx(brute_curve(labels, scores, 20.0, 200.0, 0.2))
    assert [r["threshold"] for r in rows] == np.linspace(0, 1, 101).tolist()


def test_the_lowest_of_equally_good_thresholds_is_taken(spark):
    # a contact costs 2 and a reached positive brings 0.5 * 9: 0.44 and above (three of four rows) is best,
    # and every threshold above 0.31 reaches the same rows
    df = scored(spark, [0, 1, 0, 1, 1], [0.31, 0.44, 0.52, 0.66, 0.83])
    cuts = C.fit_cut_points(df, "p", economics=(2.0, 9.0, 0.5))
    assert cuts.t_star == pytest.approx(0.32) and cuts.best_ev == pytest.approx(3 * 4.5 - 4 * 2)
    assert cuts.break_even == pytest.approx(4 / 9)


def test_the_middle_cut_halves_the_rows_that_are_not_contacted(spark):
    df = scored(spark, [0, 0, 0, 0, 1], [0.05, 0.15, 0.35, 0.37, 0.95])
    cuts = C.fit_cut_points(df, "p", economics=(4.0, 10.0, 0.5))
    assert cuts.t_star == pytest.approx(0.38) and cuts.t_mid == pytest.approx(0.25)


def test_middle_cut_without_lower_scores(spark):
    cuts = C.fit_cut_points(scored(spark, [1, 1], [0.9, 0.95]), "p", economics=(1.0, 100.0, 0.5))
    assert cuts.t_star == 0.0 and cuts.t_mid == 0.0


def test_nobody_is_contacted_when_no_contact_pays(spark):
    cuts = C.fit_cut_points(scored(spark, [0, 0, 1], [0.3, 0.5, 0.74]), "p", economics=(50.0, 200.0, 0.2))
    assert cuts.best_ev == 0.0 and cuts.t_star == 0.75


def test_sensitivity_compares_fitted_contacts_with_contacting_everyone(spark):
    validation = scored(spark, [1, 1, 0, 0], [0.8, 0.6, 0.4, 0.2])
    holdout = scored(spark, [1, 0, 1, 0, 0], [0.9, 0.7, 0.3, 0.25, 0.1])
    scenarios = {"dear": (6.0, 40.0, 0.25), "free": (0.0, 40.0, 0.25)}
    found = {r["scenario"]: r for r in C.sensitivity(validation, holdout, "p", scenarios=scenarios).collect()}
    assert found["dear"]["break_even"] == pytest.approx(0.6) and found["free"]["break_even"] == 0.0
    # fitted at 0.41: one positive and one negative of five hold-out rows are reached
    assert found["dear"]["ev_target_per_1k"] == pytest.approx((10 - 2 * 6) / 5 * 1000)
    assert found["dear"]["ev_all_per_1k"] == pytest.approx((2 * 10 - 5 * 6) / 5 * 1000)
    assert found["free"]["ev_target_per_1k"] == found["free"]["ev_all_per_1k"] == pytest.approx(4000)


def test_strange_scores_are_not_contacted(spark):
    rows = [(1, 0.9), (0, float("nan")), (0, None), (1, float("inf")), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "churned int, p double")
    row = C.value_at(df, "p", 0.5, (20.0, 200.0, 0.2)).first()
    assert (row["tp"], row["fp"], row["ev"]) == (2, 0, pytest.approx(40.0))
    step = C.grid_counts(df, "p").filter("step = 50").first()
    assert (step["tp"], step["fp"]) == (2, 0)


def test_own_grid(spark):
    df = scored(spark, [0, 1, 1, 0], [0.2, 0.4, 0.6, -1.0])
    rows = C.grid_counts(df, "p", grid=[0.0, 0.4, 0.5, 0.61]).orderBy("step").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, 2, 1), (1, 0.4, 2, 0), (2, 0.5, 1, 0), (3, 0.61, 0, 0)]
    with pytest.raises(ValueError):
        C.grid_counts(df, "p", grid=[0.5, 0.4])


def test_no_uplift_and_no_rows_have_no_break_even_and_no_rate(spark):
    assert C.CutPoints(1.0, 5.0, 0.0, 0.5, 0.2, 0.0).break_even is None
    df = scored(spark, [1, 0], [0.7, 0.2])
    row = C.sensitivity(df, df.limit(0), "p", scenarios={"s": (1.0, 5.0, 0.5)}).first()
    assert row["ev_target_per_1k"] is None and row["ev_all_per_1k"] is None


def test_value_off_the_grid(spark):
    df = scored(spark, [0, 1, 1], [0.305, 0.305, 0.9])
    assert C.value_at(df, "p", 0.3055, (20.0, 200.0, 0.2)).first()["ev"] == pytest.approx(20.0)


def test_grid_counts_by_group(spark):
    df = scored(spark, [0, 1, 1, 0], [0.2, 0.4, 0.6, 0.8]).withColumn("g", F.col("p") > 0.5)
    rows = {(r["g"], r["step"]): (r["tp"], r["fp"]) for r in C.grid_counts(df, "p", by=["g"]).collect()}
    assert len(rows) == 202 and rows[(False, 0)] == (1, 1) and rows[(True, 70)] == (0, 1)


def test_contact_list(spark):
    df = spark.createDataFrame([("a", 0.5, 10.0), ("b", 0.1, 100.0), ("c", 0.9, 1.0)], "customer_id string, p double, v double")
    assert [r[0] for r in C.contact_list(df, "p", "v", 2).collect()] == ["b", "a"]
