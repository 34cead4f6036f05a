import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import prep as P


def numbers(spark, *values, name="monthly_spend"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_bounds_are_learned_once_and_then_fixed(spark):
    stage = P.QuantileClip(columns=["monthly_spend"], lower=0.25, upper=0.5)
    model = stage.fit(numbers(spark, 8.0, 2.0, 6.0, 4.0, 10.0))  # quartile 4, median 6
    out = model.transform(numbers(spark, -70.0, 5.0, 70.0, None))
    assert [r[0] for r in out.collect()] == [4.0, 5.0, 6.0, None]
    more = stage.fit(numbers(spark, 8.0, 2.0, 6.0, 4.0, 10.0, 90.0, 95.0))
    assert json.loads(more.getOrDefault("bounds"))["monthly_spend"] != json.loads(model.getOrDefault("bounds"))["monthly_spend"]


def test_columns_that_are_not_named_stay(spark):
    df = spark.createDataFrame([(float(v), 10 * v) for v in range(9)], "x double, y int")
    out = P.QuantileClip(columns=["x", "nowhere"], lower=0.0, upper=0.5).fit(df).transform(df)
    assert sorted(r["y"] for r in out.collect()) == [10 * v for v in range(9)]
    assert out.agg(F.max("x")).first()[0] == 4.0
    assert set(json.loads(P.QuantileClip().fit(df).getOrDefault("bounds"))) == {"x", "y"}


def test_levels_are_bounded_for_each_column_and_split(spark, monkeypatch):
    rows = [(f"a{i % 60}", f"b{i % 7}", i % 2) for i in range(480)]
    df = spark.createDataFrame(rows, "wide string, narrow string, g int")
    monkeypatch.setattr(P, "MAX_LEVELS", 60)
    assert len(P.learn_statistics(df, [], ["wide", "narrow"], [], group="g")) == 2  # 134 levels in all, 60 at most in one
    monkeypatch.setattr(P, "MAX_LEVELS", 29)
    with pytest.raises(ValueError, match="wide has 30 levels"):
        P.learn_statistics(df, [], ["wide", "narrow"], [], group="g")


def test_statistics_equal_numpy(spark):
    values = [1.0, 2.0, None, 10.0, 4.0]
    stats = P.learn_statistics(numbers(spark, *values, name="x"), ["x"], [], [])[None].numbers[0]
    filled = np.array([1.0, 2.0, 3.0, 10.0, 4.0])
    assert stats.median == 3.0 and stats.had_missing
    assert stats.mean == pytest.approx(filled.mean()) and stats.scale == pytest.approx(filled.std())
    assert stats.missing_mean == pytest.approx(0.2) and stats.missing_scale == pytest.approx(0.4)


def test_median_is_taken_after_clipping(spark):
    """Two rows and uneven bounds: the clipped pair has another midpoint than the raw pair."""
    stats = P.learn_statistics(
        numbers(spark, 0.0, 100.0, name="x"), ["x"], [], ["x"], lower=0.0, upper=0.75
    )[None].numbers[0]
    assert (stats.low, stats.high, stats.median) == (0.0, 75.0, 37.5)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "x double, y double")
    stats = P.learn_statistics(df, ["x", "y"], [], [])[None]
    assert stats.numbers[0].scale == 1.0 and not stats.numbers[0].had_missing
    assert stats.feature_names() == ["x", P.INDICATOR + "y"]


def test_most_frequent_level_ties_and_unseen_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "region string")
    model = P.FeaturePrep(numeric=[], categorical=["region"], clipped=[]).fit(df)
    assert model.learned.levels[0].fill == "a"
    out = model.transform(spark.createDataFrame([("b",), (None,), ("zzz",)], "region string"))
    vectors = [r[0] for r in out.select(vector_to_array("features")).collect()]
    assert vectors == [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    assert model.feature_names == ["region_a", "region_b"]


def test_training_rows_alone_decide_the_scale(population):
    rows = P.add_derived_features(P.repair_ranges(population))
    train = rows.filter(F.substring(S.ID, 3, 4).cast("int") % 3 != 0)
    one = P.FeaturePrep().fit(train).learned.usable_numbers
    both = P.FeaturePrep().fit(rows).learned.usable_numbers
    assert any(a.mean != b.mean for a, b in zip(one, both))


def test_grouped_statistics_equal_single_fits(population):
    rows = P.add_derived_features(P.repair_ranges(population)).withColumn(
        "g", F.when(F.substring(S.ID, 3, 4).cast("int") % 2 == 0, "even").otherwise("odd")
    )
    together = P.learn_statistics(rows, group="g")
    for g in ("even", "odd"):
        alone = P.learn_statistics(rows.filter(F.col("g") == g))[None]
        assert together[g].feature_names() == alone.feature_names()
        for a, b in zip(together[g].numbers, alone.numbers):
            assert (a.low, a.high, a.median) == (b.low, b.high, b.median)
            assert a.mean == pytest.approx(b.mean) and a.scale == pytest.approx(b.scale)
        assert [v.fill for v in together[g].levels] == [v.fill for v in alone.levels]


def test_stage_survives_saving(spark, population, tmp_path):
    rows = P.add_derived_features(P.repair_ranges(population))
    model = P.FeaturePrep().fit(rows)
    model.write().overwrite().save(str(tmp_path / "prep"))
    again = P.FeaturePrepModel.load(str(tmp_path / "prep"))
    first = model.transform(rows).select(S.ID, vector_to_array("features").alias("f"))
    second = again.transform(rows).select(S.ID, vector_to_array("features").alias("f"))
    assert first.exceptAll(second).count() == 0


def test_prepared_features_of_odd_names_levels_and_values(spark):
    """SQL text keeps the bits of numbers and takes any level and column name; a vector is one parsed expression."""
    from ebbtide.operators import prep

    levels = ["it's", 'a "b"', "c\\d", "ünï", ""]
    rows = [(v, x) for v, x in zip([*levels, None], [1e-300, -3.3, 1e17 / 3, float("nan"), None, 0.1])]
    df = spark.createDataFrame(rows, "`a b` string, `x-y` double")
    stats = prep.PrepStatistics(
        [prep.NumberStat("x-y", -2.7, 1e16 / 7, 0.3, True, -1e-17, 1 / 3, 2 / 6, 0.7)], [prep.LevelStat("a b", "it's", sorted(levels))]
    )
    found = prep.FeaturePrepModel(statistics=stats.to_json()).transform(df).collect()
    for (level, x), row in zip(rows, found):
        missing = x is None or x != x
        number = (0.3 + 1e-17) / (1 / 3) if missing else (min(max(x, -2.7), 1e16 / 7) + 1e-17) * (1.0 / (1 / 3))
        mark = ((1.0 if missing else 0.0) - 2 / 6) / 0.7
        hot = [1.0 if v == ("it's" if level is None else level) else 0.0 for v in sorted(levels)]
        assert row["features"].toArray().tolist() == [number, mark, *hot]
    assert set(prep.prepared_texts(stats)) == set(stats.feature_names())
