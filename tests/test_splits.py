from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import splits as P
from ebbtide.operators.contracts import ContractError


def test_holdout_has_exact_class_shares(population):
    marked = P.with_holdout(population)
    sizes = Counter((r[S.LABEL], r["is_holdout"]) for r in marked.collect())
    classes = Counter(r[S.LABEL] for r in population.collect())
    quotas = P.holdout_quotas(dict(classes))
    assert {c: sizes[(c, True)] for c in classes} == quotas and sum(quotas.values()) == 48


def test_quotas_use_largest_remainders():
    assert P.holdout_quotas({0: 826, 1: 774}) == {0: 165, 1: 155}
    assert sum(P.holdout_quotas({0: 7, 1: 4}).values()) == 3


def test_same_seed_same_split(population):
    first, again = P.with_holdout(population, seed=5), P.with_holdout(population.repartition(7), seed=5)
    other = P.with_holdout(population, seed=6)
    assert first.exceptAll(again).count() == 0
    assert first.exceptAll(other).count() > 0


@pytest.mark.parametrize("folds", [2, 3, 5])
def test_fold_starts_balance_folds_and_classes(folds):
    sizes = {0: 13, 1: 9}
    starts = P.fold_starts(sizes, folds)
    shares = {c: [b - a for a, b in zip([0, *starts[c]], [*starts[c], n])] for c, n in sizes.items()}
    totals = [sum(shares[c][f] for c in sizes) for f in range(folds)]
    for counts in [*shares.values(), totals]:
        assert max(counts) - min(counts) <= 1


def test_repeats_are_whole_balanced_and_different(population):
    folded = P.with_repeated_folds(population, folds=5, repeats=3)
    rows = folded.collect()
    for r in range(3):
        per_class = Counter((row[S.LABEL], row[f"fold_{r}"]) for row in rows)
        for c in (0, 1):
            counts = [per_class[(c, f)] for f in range(5)]
            assert max(counts) - min(counts) <= 1
    assert any(row["fold_0"] != row["fold_1"] for row in rows)


def test_inner_folds_skip_the_outer_fold(population):
    folded = P.with_inner_folds(P.with_folds(population, folds=3, name="outer"), "outer", 3, folds=4)
    for row in folded.collect():
        for o in range(3):
            assert (row[f"inner_{o}"] is None) == (row["outer"] == o)
    counts = Counter(r["inner_0"] for r in folded.filter("outer <> 0 AND churned = 1").collect())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_ordered_folds_are_consecutive(spark):
    df = spark.range(20).select(F.col("id").alias(S.ID), (F.col("id") % 2).cast("int").alias(S.LABEL))
    rows = P.with_folds(df, folds=5, order=S.ID).orderBy(S.ID).collect()
    for c in (0, 1):
        folds = [r["fold"] for r in rows if r[S.LABEL] == c]
        assert folds == sorted(folds) and set(folds) == set(range(5))


def ordered(population, kind):
    number = F.substring(S.ID, 3, 4).cast("int")
    return {"constant": F.lit(7), "few": F.floor(number / 50), "hot": F.when(number % 3 == 0, 1).otherwise(number)}[kind]


@pytest.mark.parametrize("kind", ["constant", "few", "hot"])
def test_shares_are_exact_when_order_values_collide(population, kind):
    classes = Counter(r[S.LABEL] for r in population.collect())
    order = ordered(population, kind)
    marked = P.with_holdout(population, order=order)
    sizes = Counter((r[S.LABEL], r["is_holdout"]) for r in marked.collect())
    assert {c: sizes[(c, True)] for c in classes} == P.holdout_quotas(dict(classes))
    starts = P.fold_starts(dict(classes), 5)
    folded = P.with_folds(population.withColumn("o", order), order="o").collect()
    counts = Counter((r[S.LABEL], r["fold"]) for r in folded)
    for c, n in classes.items():
        assert [counts[(c, f)] for f in range(5)] == [b - a for a, b in zip([0, *starts[c]], [*starts[c], n])]
    per_value = {}
    for r in folded:  # folds still follow the order
        low, high = per_value.get((r[S.LABEL], r["fold"]), (r["o"], r["o"]))
        per_value[(r[S.LABEL], r["fold"])] = min(low, r["o"]), max(high, r["o"])
    assert all(per_value[(c, f)][1] <= per_value[(c, f + 1)][0] for c in classes for f in range(4))


def test_colliding_tie_hashes_are_told_apart_by_the_next(population, monkeypatch):
    number = F.substring(S.ID, 3, 4).cast("int")
    monkeypatch.setattr(P, "_tie", lambda level: F.lit(5) if level == 1 else F.floor(number / F.lit(10 if level == 2 else 1)))
    folded = P.with_inner_folds(
        P.with_folds(population, folds=3, order=F.lit(0), name="outer"), "outer", 3, folds=4, order=F.lit(1)
    ).collect()
    for c in (0, 1):
        outer = Counter(r["outer"] for r in folded if r[S.LABEL] == c)
        assert max(outer.values()) - min(outer.values()) <= 1
        for o in range(3):
            inner = Counter(r[f"inner_{o}"] for r in folded if r[S.LABEL] == c and r["outer"] != o)
            assert set(inner) == set(range(4)) and max(inner.values()) - min(inner.values()) <= 1


def test_rows_that_share_an_id_stay_together(population):
    doubled = population.limit(40).withColumn(S.ID, F.lit("same"))
    folded = P.with_folds(doubled, folds=4)
    assert folded.groupBy(S.LABEL).agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folded.filter("fold IS NULL").count() == 0


def test_smoke_sample_is_fixed(population):
    first = P.smoke_sample(population, 50)
    assert first.count() == 50 and first.exceptAll(P.smoke_sample(population.repartition(5), 50)).count() == 0


def test_rows_without_a_label_are_an_error(population):
    some = population.withColumn(S.LABEL, F.when(F.col(S.ID) != "id0007", F.col(S.LABEL)))
    for split in (P.with_holdout, P.with_folds, P.with_repeated_folds):
        with pytest.raises(ContractError, match="1 rows have no churned"):
            split(some)


def test_labels_with_many_values_are_an_error(population, monkeypatch):
    monkeypatch.setattr(P, "MAX_CLASSES", 50)
    with pytest.raises(ContractError, match="too many values"):
        P.with_folds(population, label=S.ID)
