from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import ranking
from ebbtide.operators import resample as R


def scored(spark, labels, *scores):
    rows = [(f"c{i}", int(y), *map(float, s)) for i, (y, *s) in enumerate(zip(labels, *scores))]
    names = ["p", "q"][: len(scores)]
    return spark.createDataFrame(rows, "customer_id string, churned int, " + ", ".join(f"{n} double" for n in names))


def test_an_interval_without_overlap_is_a_point(spark):
    df = scored(spark, [1, 0, 1, 0, 0], [0.93, 0.41, 0.88, 0.17, 0.52])
    row = R.auc_interval(df, "p", rounds=150).first()
    assert row["auc_lo"] == row["auc_hi"] == 1.0
    assert 100 < row["n_rounds"] < 150  # a round that drew one class only has no AUC


def test_a_score_does_not_differ_from_a_copy_of_itself(spark):
    p = [0.31, 0.77, 0.58, 0.12, 0.49, 0.66, 0.23]
    df = scored(spark, [0, 1, 0, 0, 1, 1, 0], p, p)
    for other in ("p", "q"):
        row = R.auc_difference_interval(df, "p", other, rounds=80).first()
        assert (row["diff_lo"], row["diff_mean"], row["diff_hi"]) == (0.0, 0.0, 0.0)


def tied_data(n=600):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * labels + rng.random(n) * 0.7, 0, 1), 2)
    p[::3] = 0.5  # one score holds a third of all rows
    return labels, p, np.round(rng.random(n), 1)


def test_draws_do_not_depend_on_pieces(spark):
    labels, p, q = tied_data()
    df = scored(spark, labels, p, q)
    frames = [
        R.bootstrap_aucs(df, ["p", "q"], rounds=20, pieces=k).toPandas().sort_values(["which", "round"])["auc"].to_numpy()
        for k in (2, 7, 40)
    ]
    assert np.allclose(frames[0], frames[1]) and np.allclose(frames[0], frames[2])


def test_small_blocks_and_batches_give_the_same_sums():
    """Ties that cross blocks and batches are carried over."""
    rng = np.random.default_rng(8)
    n = 120
    cells = pd.DataFrame(
        {
            "which": 0,
            "piece": np.sort(rng.integers(0, 3, n)),
            "cell": rng.integers(-(2**62), 2**62, n),
            "y": rng.integers(0, 2, n),
            "n": rng.integers(1, 5, n),
        }
    )
    cells["score"] = cells["piece"] + np.round(rng.random(n), 1)
    cells = cells.sort_values(["which", "piece", "score"], ignore_index=True)
    whole = pd.concat(R._piece_sums(30)(iter([cells])))
    parts = pd.concat(R._piece_sums(30, block=4)(iter([cells.iloc[i : i + 7] for i in range(0, n, 7)])))
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), parts.reset_index(drop=True))


def test_interval_agrees_with_a_row_bootstrap(spark):
    labels, p, _ = tied_data()
    df = scored(spark, labels, p)
    row = R.auc_interval(df, "p", rounds=400).first()
    rng = np.random.default_rng(0)

    def auc(y, s):
        pos, neg = s[y == 1], s[y == 0]
        return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()

    draws = [auc(labels[i], p[i]) for i in rng.integers(0, len(p), (400, len(p)))]
    lo, hi = np.quantile(draws, [0.025, 0.975])
    assert row["auc_lo"] == pytest.approx(lo, abs=0.012) and row["auc_hi"] == pytest.approx(hi, abs=0.012)
    assert row["auc_lo"] < ranking.roc_auc(df, "p").first()[0] < row["auc_hi"]


def test_every_round_draws_exactly_the_rows_of_the_table(spark):
    labels, p, q = tied_data()
    df = scored(spark, labels, p, q).unionByName(scored(spark, [1, 0], [float("nan"), 0.2], [0.5, float("nan")]))
    draws = R.bootstrap_aucs(df, ["p", "q"], rounds=60).toPandas()
    assert (draws["n_rows"] == 600).all() and len(draws) == 120


def drawn_rows(spark, share, redrawn, lacking, counts):
    """Rows that each cell gives to each round."""
    cells = spark.createDataFrame(
        [(float(i), i % 2, n, hash((i, 11)) % 2**62) for i, n in enumerate(counts)], "p double, y int, n long, cell long"
    )
    extra = R._single_rows(cells, ["p", "y"], sum(counts), lacking, seed=4)
    frame = cells.join(extra, ["p", "y"], "left").toPandas().sort_values("p", ignore_index=True)
    rounds = len(lacking)
    out = np.zeros((len(counts), rounds))
    for i in range(len(counts)):  # one cell alone: its positives and negatives are its rows
        one = frame.iloc[[i]].assign(which=0, piece=0, score=0.0)
        sums = pd.concat(R._piece_sums(rounds, share, redrawn)(iter([one])))
        out[i] = sums["pos"] + sums["neg"]
    return out


def test_single_rows_are_drawn_in_proportion(spark):
    counts = [1, 1, 2, 5, 40, 200, 1]  # one cell holds most rows and lies in many pieces
    rounds = 400
    out = drawn_rows(spark, 0.0, (), {r: 250 for r in range(rounds)}, counts)
    assert (out.sum(axis=0) == 250).all()
    expected = np.array(counts) / 250 * 250
    assert np.abs(out.mean(axis=1) - expected).max() < 5 * np.sqrt(max(counts) * 0.25 / rounds)
    assert out[5].var() == pytest.approx(250 * 0.8 * 0.2, rel=0.3)


def test_a_round_that_drew_too_many_takes_single_rows_alone(spark):
    out = drawn_rows(spark, 0.9, [1], {0: 0, 1: 12, 2: 3}, [3, 4, 5])
    weights = R._poisson_weights(3, 0.9, R.LARGE)
    assert out[:, 1].sum() == 12
    own = weights(np.array([hash((i, 11)) % 2**62 for i in range(3)]), np.array([3, 4, 5])).sum(axis=0)
    assert out[:, 0].sum() == own[0] and out[:, 2].sum() == own[2] + 3


def test_no_usable_rows_give_no_rounds(spark):
    row = R.auc_interval(scored(spark, [1], [float("nan")]), "p", rounds=5).first()
    assert (row["auc_lo"], row["n_rounds"]) == (None, 0)


def test_permutation_is_a_bijection(population):
    out = R.permuted_pairs(population.select(S.ID, "monthly_spend"), [S.ID, "monthly_spend"], 3).collect()
    for r in range(3):
        rows = [x for x in out if x["repeat"] == r]
        assert len({x[S.ID] for x in rows}) == len(rows) == 240
        assert Counter(x[f"donor_{S.ID}"] for x in rows) == Counter(x[S.ID] for x in rows)
    moved = [x for x in out if x["repeat"] == 0 and x[S.ID] != x[f"donor_{S.ID}"]]
    assert len(moved) > 200


def test_permuted_column_leaves_the_rest(population):
    out = R.permute_column(population, "region")
    assert out.columns == population.columns
    assert out.drop("region").exceptAll(population.drop("region")).count() == 0
    assert out.filter(F.col("region").isNotNull()).count() == 240
