from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions import columns as X
from ebbtide.operators.prep import add_derived_features, repair_ranges


def one(df, column):
    return df.first()[column]


def test_values_outside_their_range_become_missing(customers):
    changes = [{"account_age_days": 3651}, {"monthly_spend": -0.01}, {"days_since_last_login": 366}, {}]
    rows = repair_ranges(customers(*changes)).orderBy(S.ID).collect()
    for row, change in zip(rows, changes):
        for column in ("account_age_days", "monthly_spend", "days_since_last_login"):
            assert (row[column] is None) == (column in change)
    assert rows[3]["account_age_days"] == 731.0 and rows[0]["days_since_last_login"] == 41.0


def test_range_ends_are_valid(customers):
    row = repair_ranges(customers({"account_age_days": 3650, "days_since_last_login": 0})).first()
    assert row["account_age_days"] == 3650.0 and row["days_since_last_login"] == 0.0


def test_columns_are_repaired_one_by_one(customers):
    row = repair_ranges(customers({"num_orders_last_90d": -2, "pages_per_session": 0.0})).first()
    assert row["num_orders_last_90d"] is None and row["pages_per_session"] == 0.0
    assert (row["monthly_spend"], row["avg_order_value"]) == (62.5, 31.25)


def test_derived_features(customers):
    changes = [
        {"account_age_days": 99, "days_since_last_login": 25},
        {"days_since_last_login": 90, "num_orders_last_90d": None, "support_tickets_raised": 7},
        {"days_since_last_login": 91, "num_orders_last_90d": 1, "support_tickets_raised": 3},
        {"account_age_days": None},
    ]
    rows = add_derived_features(repair_ranges(customers(*changes))).orderBy(S.ID).collect()
    assert rows[0]["recency_ratio"] == 0.25 and rows[3]["recency_ratio"] is None
    assert [r["is_dormant"] for r in rows] == [0.0, 0.0, 1.0, 0.0]
    assert [r["support_per_order"] for r in rows[:3]] == [0.5, 7.0, 1.5]


def test_nan_and_text_become_missing(spark):
    df = spark.createDataFrame([("abc",), ("NaN",), ("7.5",), (None,)], "x string")
    assert [r[0] for r in df.select(X.number_or_null("x")).collect()] == [None, None, 7.5, None]


def test_ratio_with_zero_divisor_is_missing(spark):
    df = spark.createDataFrame([(-1, 10)], "account_age_days int, days_since_last_login int")
    assert df.select(X.recency_ratio().alias("r")).first()["r"] is None


def test_tiers_depend_on_the_row_only(spark):
    df = spark.createDataFrame([(0.9,), (0.45,), (0.1,), (None,), (float("nan"),)], "p double")
    tiers = [r[0] for r in df.select(X.risk_tier(F.col("p"), 0.6, 0.3)).collect()]
    assert tiers == ["high", "medium", "low", "low", "low"]
    assert df.filter("p = 0.45").select(X.risk_tier(F.col("p"), 0.6, 0.3)).first()[0] == "medium"


def test_grid_step_agrees_with_comparisons(spark):
    scores = [i * 0.01 for i in range(101)] + [0.005, 0.57, 0.5699999999999999, 0.999, 1.0, 1.5, 0.29]
    df = spark.createDataFrame([(s,) for s in scores], "p double")
    got = [r[0] for r in df.select(X.grid_step(F.col("p"))).collect()]
    assert got == [max(k for k in range(101) if k * 0.01 <= s) for s in scores]


def test_grid_step_of_unusable_scores(spark):
    df = spark.createDataFrame([(-0.1,), (None,), (float("nan"),), (float("-inf"),), (float("inf"),)], "p double")
    assert [r[0] for r in df.select(X.grid_step(F.col("p"))).collect()] == [None] * 4 + [100]


def test_reason_text_and_ties(spark):
    df = spark.range(1).select(X.double_array([-3, 3, -1, 0]).alias("c"))
    text = df.select(X.reason_codes(F.col("c"), ["a", "b", "c", "d"], 3)).first()[0]
    assert text == "a(-); b(+); c(-)"
    assert df.select(X.reason_codes(F.col("c"), ["a", "b", "c", "d"], 4)).first()[0].endswith("d(+)")


def test_drift_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.21,)], "psi double")
    bands = [r[0] for r in df.select(X.drift_band(F.col("psi"))).collect()]
    assert bands == ["stable", "watch", "watch", "investigate"]
