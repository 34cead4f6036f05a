import numpy as np
import pytest

from ebbtide import settings as S
from ebbtide.operators import ranking as R


def scored(spark, labels, scores, models=None):
    models = models or ["m"] * len(labels)
    return spark.createDataFrame(list(zip(models, labels, map(float, scores))), "model string, churned int, p double")


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(labels, scores):
    total, last, out = sum(labels), 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        hit = [y for y, s in zip(labels, scores) if s >= t]
        out += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    return out


def test_auc_counts_won_and_tied_pairs(spark):
    # positives 0.95, 0.55, 0.3 win 3, 1 and 1 of the pairs with 0.7, 0.55, 0.05; one pair is tied
    df = scored(spark, [1, 0, 1, 0, 1, 0], [0.95, 0.7, 0.55, 0.55, 0.3, 0.05])
    assert R.roc_auc(df, "p").first()[0] == pytest.approx(5.5 / 9)


def test_a_threshold_splits_the_rows_into_four(spark):
    df = scored(spark, [1, 1, 0, 1, 0, 0, 1], [0.8, 0.35, 0.75, 0.6, 0.5, 0.1, 0.2])
    row = R.classification_metrics(df, "p", 0.55).first()
    assert (row["precision"], row["recall"]) == (pytest.approx(2 / 3), 0.5)
    assert row["f1"] == pytest.approx(4 / 7)
    assert R.confusion_counts(df, "p", 0.55).first().asDict() == {"tn": 2, "fp": 1, "fn": 2, "tp": 2}


def test_average_precision_is_a_step_sum(spark):
    # recall grows by a third at 0.9, 0.5 and 0.2, where 1 of 2, 2 of 3 and 3 of 4 rows are positive
    df = scored(spark, [1, 0, 1, 1, 0], [0.9, 0.9, 0.5, 0.2, 0.1])
    assert R.average_precision(df, "p").first()[0] == pytest.approx((1 / 2 + 2 / 3 + 3 / 4) / 3)


@pytest.mark.parametrize("edges", [[], [0.2, 0.5, 0.8]])
def test_against_brute_force_by_group(spark, edges):
    rng = np.random.default_rng(11)
    labels = [int(v) for v in rng.integers(0, 2, 300)]
    scores = [round(float(v), 2) for v in rng.random(300)]
    scores[::3] = [0.5] * 100  # one score holds a third of all rows
    models = ["a" if i < 200 else "b" for i in range(300)]
    out = {r["model"]: r for r in R.classification_metrics(
        scored(spark, labels, scores, models), "p", 0.5, by=["model"], edges=edges).collect()}
    for m, part in (("a", slice(0, 200)), ("b", slice(200, 300))):
        y, p = labels[part], scores[part]
        assert out[m]["roc_auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
        assert out[m]["pr_auc"] == pytest.approx(brute_ap(y, p), abs=1e-12)
        assert out[m]["brier"] == pytest.approx(np.mean((np.array(p) - y) ** 2), abs=1e-12)


def test_empty_denominators_give_zero(spark):
    row = R.classification_metrics(scored(spark, [0, 1], [0.1, 0.2]), "p", 0.9).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_one_class_has_no_auc(spark):
    df = scored(spark, [1, 1], [0.1, 0.2])
    assert R.roc_auc(df, "p").first()[0] is None
    assert tuple(R.confusion_counts(df, "p", 0.15).first()) == (0, 0, 1, 1)


def test_roc_area_equals_auc(spark):
    labels, scores = [0, 1, 0, 1, 1, 0], [0.1, 0.6, 0.6, 0.8, 0.4, 0.4]
    points = sorted((r["fpr"], r["tpr"]) for r in R.roc_points(scored(spark, labels, scores), "p").collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert area == pytest.approx(brute_auc(labels, scores))


def test_precision_recall_points(spark):
    rows = R.precision_recall_points(scored(spark, [0, 1, 1], [0.2, 0.2, 0.9]), "p").collect()
    found = {r["threshold"]: (r["precision"], r["recall"], r["base_rate"]) for r in rows}
    assert found[0.9] == (1.0, 0.5, pytest.approx(2 / 3))
    assert found[0.2] == (pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3))


def test_reliability_bins_are_closed_on_the_right(spark):
    rows = R.reliability(scored(spark, [0, 1, 1, 0], [0.0, 0.1, 0.10001, 1.0]), "p").collect()
    assert {r["bin"]: r["n"] for r in rows} == {0: 2, 1: 1, 9: 1}


NAN, INF = float("nan"), float("inf")


def strange(spark):
    """Scores that are infinite, not a number or missing, and a missing label."""
    rows = [(1, INF), (0, -INF), (1, 0.4), (0, 0.6), (1, NAN), (0, NAN), (1, None), (None, 0.9), (1, 0.7), (0, 0.1)]
    return spark.createDataFrame(rows, "churned int, p double")


@pytest.mark.parametrize("edges", [None, [], [0.5]])
def test_missing_scores_are_left_out_and_infinite_ones_rank(spark, edges):
    df = strange(spark)
    labels, scores = [1, 0, 1, 0, 1, 0], [INF, -INF, 0.4, 0.6, 0.7, 0.1]
    assert R.roc_auc(df, "p", edges=edges).first()[0] == pytest.approx(brute_auc(labels, scores))
    assert R.average_precision(df, "p", edges=edges).first()[0] == pytest.approx(brute_ap(labels, scores))
    assert {r["threshold"] for r in R.roc_points(df, "p", edges=edges).collect()} == {None, *scores}
    assert R.precision_recall_points(df, "p", edges=edges).count() == 6


def test_threshold_counts_and_metrics_agree_on_strange_scores(spark):
    df = strange(spark)
    counts = R.confusion_counts(df, "p", 0.5).first()
    assert counts.asDict() == {"tn": 2, "fp": 1, "fn": 1, "tp": 2}
    row = R.classification_metrics(df, "p", 0.5).first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)
    finite = df.filter("p IS NULL OR isnan(p) OR abs(p) < 9")
    expected = np.mean([(0.4 - 1) ** 2, 0.6**2, (0.7 - 1) ** 2, 0.1**2])
    assert R.brier_score(finite, "p").first()[0] == pytest.approx(expected)
    assert R.classification_metrics(finite, "p").first()["brier"] == pytest.approx(expected)


def test_reliability_edges_are_evenly_stepped(spark):
    scores = [i * 0.1 for i in range(1, 10)]  # 0.30000000000000004 and the like belong to the bin below
    rows = R.reliability(scored(spark, [0] * 9, scores), "p").collect()
    assert {r["bin"]: r["n"] for r in rows} == {b: 1 for b in range(9)}


def test_nan_counts_as_missing_in_profiles(spark):
    from ebbtide.operators import profiling

    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0), (nan, 1), (3.0, 1), (None, 0)], f"monthly_spend double, {S.LABEL} int")
    assert profiling.missing_counts(df).collect()[0]["missing"] == 2
    assert profiling.rows_with_missing(df).first()[0] == 2
    row = {r["column"]: r for r in profiling.describe_numeric(df, ["monthly_spend"]).collect()}["monthly_spend"]
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
    assert profiling.outlier_profile(df, ["monthly_spend"]).first()["max"] == 3.0
