"""Fold summaries give the statistics that fits on each split alone give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import foldstats
from ebbtide.operators.foldstats import FoldStatistics, Scheme
from ebbtide.operators.prep import learn_statistics

NUMERIC, LEVELS = ["plain", "ties", "gaps", "skewed", "void"], ["kind", "rare"]
CLIPPED = ["plain", "ties", "skewed", "void"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3_000):
        rows.append(
            (
                i,
                float(rng.normal(50, 9)),
                float(rng.integers(0, 4)),
                None if i % 7 == 0 else (float("nan") if i % 11 == 0 else float(rng.exponential(3))),
                float(rng.lognormal(0, 2)),
                None,
                str(rng.choice(["a", "b", "c"])),
                None if i % 5 else f"r{i % 40}",
                int(rng.integers(0, 2)),
                int(rng.integers(0, 5)),
                int(rng.integers(0, 3)),
            )
        )
    schema = "id int, plain double, ties double, gaps double, skewed double, void double, kind string, rare string"
    return spark.createDataFrame(rows, f"{schema}, {S.LABEL} int, f int, g int").cache()


def _same(found, expected):
    for a, b in zip(found.numbers, expected.numbers):
        assert a.name == b.name and a.had_missing == b.had_missing
        for field in ("low", "high", "median", "mean", "scale", "missing_mean", "missing_scale"):
            x, y = getattr(a, field), getattr(b, field)
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12), (a.name, field)
    assert found.levels == expected.levels


def _check(table, **settings):
    inner = F.when(F.col("g") != 1, F.col("f"))
    schemes = [Scheme("f", F.col("f")), Scheme("inner", inner)]
    found = FoldStatistics(table, schemes, NUMERIC, LEVELS, CLIPPED, **settings)
    for at, rows in ((0, table), (1, table.filter("g <> 1"))):
        for fold in (None, 0, 3):
            alone = rows if fold is None else rows.filter(F.col("f") != fold)
            _same(found.statistics(at, fold), learn_statistics(alone, NUMERIC, LEVELS, CLIPPED)[None])
            assert found.sizes(at, fold) == alone.count()
        held = rows.filter("f = 3")
        assert found.fold_labels(at, 3) == (held.filter(f"{S.LABEL} = 1").count(), held.filter(f"{S.LABEL} = 0").count())
    return found


def test_equal_to_single_fits(table):
    _check(table)


def test_equal_where_brackets_are_cut_or_miss(table, monkeypatch):
    monkeypatch.setattr(foldstats, "VALUES", 20)
    monkeypatch.setattr(foldstats, "BINS", 16)
    found = _check(table)
    assert max(len(v[0]) for v in found.values.values()) < 300
    monkeypatch.setattr(foldstats, "LEAST_SLACK", 0.0)
    monkeypatch.setattr(foldstats, "SPREAD", 0.0)  # no split's rank is sure to be inside
    _check(table)


def test_one_fold_with_all_extremes(spark):
    rows = [(float(i), 0 if i >= 900 else 1 + i % 2, i % 2) for i in range(1_000)]
    df = spark.createDataFrame(rows, f"x double, f int, {S.LABEL} int")
    found = FoldStatistics(df, [Scheme("f", F.col("f"))], ["x"], [], ["x"])
    for fold in (0, 1, 2):
        _same(found.statistics(0, fold), learn_statistics(df.filter(F.col("f") != fold), ["x"], [], ["x"])[None])


def test_a_row_is_there_once_for_each_scheme(spark, population):
    from ebbtide.operators.models import TrainingSettings
    from ebbtide.plans import training

    settings = TrainingSettings()
    splits = [*training.bakeoff_splits(settings).values(), *training.calibration_splits(settings)]
    splits += [s for group in training.out_of_fold_splits(settings).values() for s in group]
    schemes = list({s.scheme: Scheme(s.scheme, s.fold) for s in splits}.values())
    train, _ = training.split_base(population, settings)
    times = foldstats._memberships(train, schemes, [S.ID]).groupBy(S.ID).count().agg(F.max("count")).first()[0]
    assert len(splits) == 45 and times == 8
