import gc
import weakref
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.catalog import learning
from ebbtide.operators import explain, models
from ebbtide.operators.models import SCORE, TrainingSettings
from ebbtide.operators.scoring import score_frame, scored_records
from ebbtide.plans import training
from ebbtide.plans.drift_job import write_drift_report
from ebbtide.session import small_table
from ebbtide.sources import runs, tables
from ebbtide.streaming import incremental

SMALL = TrainingSettings(
    folds=2, repeats=1, trees=5, forest_depth=3, boosting_rounds=2, boosting_depth=2, bootstrap_rounds=50
)


@pytest.fixture(scope="module")
def linear(population):
    return models.pipeline("logistic_regression", population.count()).fit(population)


@pytest.fixture(scope="module")
def trained(population, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs"))
    return training.train_and_evaluate(population, SMALL, folder), folder


def test_contributions_add_up_to_the_log_odds(population, linear):
    rows = explain.contributions(linear, population, "c")
    scored = models.positive_probability(linear, population).select(S.ID, SCORE)
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) + F.lit(float(linear.stages[-1].intercept))
    gaps = rows.join(scored, S.ID).select(F.abs(total - F.ln(F.col(SCORE) / (1 - F.col(SCORE)))).alias("gap"))
    assert gaps.agg(F.max("gap")).first()[0] < 1e-8


def test_linear_fit_reaches_the_penalised_optimum(population, linear):
    rows = explain.prepared_rows(linear, population).select(vector_to_array("features").alias("x"), S.LABEL).collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r[S.LABEL] for r in rows], dtype=float)
    w, b = linear.stages[-1].coefficients.toArray(), linear.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # gradient of 0.5 |w|^2 + sum of losses; the intercept is not penalised
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_sigmoid_fit_is_the_soft_target_optimum(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-1.5 * f + 0.3))).astype(int)
    df = spark.createDataFrame([(float(v), int(t)) for v, t in zip(f, y)], "f double, churned int")
    pos, neg = int(y.sum()), int((1 - y).sum())
    a, b = models.fit_sigmoid(df, F.col("f"), pos, neg)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = 1 / (1 + np.exp(-(a * f + b)))
    assert abs(((p - t) * f).sum()) < 1e-3 and abs((p - t).sum()) < 1e-3


def test_only_linear_models_are_explained(population):
    forest = models.pipeline("random_forest", 240, SMALL).fit(population)
    with pytest.raises(explain.NotLinearError):
        explain.coefficients_of(forest)
    with pytest.raises(ValueError, match="do not match"):
        explain.named_coefficients(["a", "b"], [1.0])


def test_reason_codes_and_odds_ratios(spark, population, linear):
    reasons = explain.reason_codes(linear, population, 3).collect()
    assert all(r["top_reason_codes"].count(";") == 2 for r in reasons) and len(reasons) == 240
    table = explain.coefficient_table(spark, explain.coefficients_of(linear))
    ratios = explain.odds_ratios(table).collect()
    assert [abs(r["coef"]) for r in ratios] == sorted((abs(r["coef"]) for r in ratios), reverse=True)
    assert ratios[0]["odds_ratio"] == pytest.approx(np.exp(ratios[0]["coef"]))
    named = explain.named_contributions(linear, population)
    assert named.columns == [S.ID, *explain.coefficients_of(linear)]


def test_scored_table(population, linear):
    out = score_frame(population, linear, 0.6, 0.3, linear)
    assert out.columns == [S.ID, SCORE, "risk_tier", "top_reason_codes"]
    rows = out.collect()
    assert all(0 <= r[SCORE] <= 1 for r in rows)
    tier = lambda p: "high" if p >= 0.6 else "medium" if p >= 0.3 else "low"
    assert all(r["risk_tier"] == tier(r[SCORE]) for r in rows)
    one = score_frame(population.filter(F.col(S.ID) == rows[3][S.ID]), linear, 0.6, 0.3, linear).collect()
    assert one == [rows[3]]


def test_scoring_without_id_label_and_reasons(population, linear):
    out = score_frame(population.drop(S.ID, S.LABEL).withColumn("extra", F.lit(1)), linear, 0.6, 0.3)
    assert out.columns == [S.ID, SCORE, "risk_tier"] and out.select(S.ID).distinct().count() == 240
    assert scored_records(out).filter("top_reason_codes IS NULL").count() == 240
    with pytest.raises(ValueError, match=SCORE):
        scored_records(out.withColumnRenamed(SCORE, "p"))


def cv(spark, **aucs):
    return small_table(spark, list(aucs.items()), "model string, cv_auc_mean double")


@pytest.mark.parametrize(
    "aucs, winner",
    [
        ((0.8105, 0.8195, 0.812), "logistic_regression"),  # all within the tolerance of the best
        ((0.61, 0.6401, 0.649), "random_forest"),
        ((0.71, 0.65, 0.8), "hist_gradient_boosting"),
    ],
)
def test_selection(spark, aucs, winner):
    table = cv(spark, **dict(zip(S.MODEL_PREFERENCE, aucs)))
    assert training.selection_order(table).first()["winner"] == winner


def test_selection_without_listed_models_and_runner_up(spark):
    table = cv(spark, x=0.7, y=0.71)
    assert training.selection_order(table).first()["winner"] == "y"
    assert training.runner_up(cv(spark, x=0.7, y=0.71, z=0.5), "x").first()["runner_up"] == "y"


def test_training_job(trained, population):
    result, _ = trained
    assert result.winner in S.MODEL_PREFERENCE
    assert {r["model"] for r in result.folds.collect()} == set(S.MODEL_PREFERENCE)
    ids = [r[S.ID] for r in result.train_scores.collect()]
    held = [r[S.ID] for r in result.test_scores.collect()]
    assert len(ids) == len(set(ids)) == 192 and len(held) == 48 and not set(ids) & set(held)
    items = {(scope, item) for scope, item, *_ in result.facts}
    assert {i for s, i in items if s == "candidate on hold-out"} == set(S.MODEL_PREFERENCE)
    assert {i for s, i in items if s == "scenario"} == set(S.SCENARIOS)
    assert 0 <= result.cuts.t_mid <= result.cuts.t_star <= 1


def test_saved_run_scores_the_same(spark, trained, population):
    result, folder = trained
    loaded = runs.open_newest(spark, folder)
    assert loaded.name in result.path
    assert (loaded.high_from, loaded.medium_from) == (result.cuts.t_star, result.cuts.t_mid)
    assert (loaded.linear is None) == (result.linear is None)
    assert loaded.fact("data", "row_count") == 240 and loaded.fact("training", "winner") == result.winner
    assert loaded.fact("no such", "fact") is None
    assert sorted(map(str, loaded.facts)) == sorted(map(str, result.facts))
    kept = runs.facts_of_all(spark, folder).filter("scope = 'cuts' AND name = 'high_from'").collect()
    assert [(r["run"], r["number"]) for r in kept] == [(loaded.name, result.cuts.t_star)]
    cuts = result.cuts
    before = score_frame(population, result.scorer, cuts.t_star, cuts.t_mid, result.linear)
    assert loaded.score(population).exceptAll(before).count() == 0


def test_newest_run_wins_and_missing_runs_are_reported(spark, trained, linear, tmp_path):
    with pytest.raises(runs.RunNotFoundError):
        runs.newest_run(spark, str(tmp_path))
    with pytest.raises(runs.RunNotFoundError):
        runs.open_run(spark, str(tmp_path / "no-run"))
    facts = runs.facts_about("cuts", {"medium_from": 0.3, "high_from": 0.6, "unknown": None, "note": "by hand"})
    first, second = (runs.save_run(spark, {runs.SCORER: linear}, facts, str(tmp_path)) for _ in range(2))
    assert first != second and runs.newest_run(spark, str(tmp_path)) == second
    # without its seal a run is not complete
    (tmp_path / second.rsplit("/", 1)[-1] / "seal").rename(tmp_path / "broken")
    assert runs.newest_run(spark, str(tmp_path)) == first
    assert runs.facts_of_all(spark, str(tmp_path)).select("run").distinct().count() == 1
    opened = runs.open_run(spark, first)
    assert opened.linear is None and opened.fact("cuts", "note") == "by hand" and opened.high_from == 0.6


def test_flat_ensemble_is_the_mean_of_its_members(population, trained):
    model = trained[0].scorer
    members = [s for s in model.stages if isinstance(s, models.SigmoidScore)]
    assert isinstance(model, PipelineModel) and len(members) == SMALL.folds
    out = model.transform(population)
    assert not [c for c in out.columns if c.startswith(("raw_", "score_", "features_"))]


def test_permutation_importance_finds_the_signal(population, linear):
    rows = training.permutation_importance(linear, population, repeats=2).collect()
    assert [r["feature"] for r in rows][0] == "days_since_last_login" and len(rows) == len(S.RAW_FEATURES)
    assert rows[0]["importance"] > 0.05


def test_ablation(population):
    settings = replace(SMALL, models=("logistic_regression",))
    train, _ = training.split_base(population, settings)
    subsets = {"plan": ((), ("subscription_plan",)), "recency": (("days_since_last_login",), ())}
    rows = training.ablation(train, settings, subsets).collect()
    assert {r["subset"] for r in rows} == {"plan", "recency"}
    assert all(0 <= r["cv_auc_mean"] <= 1 for r in rows)


def test_drift_job_with_a_run(spark, trained, population, tmp_path):
    paths = write_drift_report(population, population, str(tmp_path / "d"), runs_folder=trained[1])
    row = spark.read.parquet(paths["prediction_drift"]).first()
    assert row["score_psi"] == 0.0 and row["ref_mean_score"] == row["cur_mean_score"]


def test_stream_equals_batch(spark, population, linear, tmp_path):
    rows = population.drop(S.LABEL).withColumn(
        "region", F.when(F.col(S.ID) == "id0003", None).otherwise(F.col("region"))
    ).withColumn(S.ID, F.when(F.col(S.ID) == "id0005", None).otherwise(F.col(S.ID)))
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    run = runs.ScoringRun("r1", linear, {"high_from": 0.6, "medium_from": 0.3}, linear)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scored, bad = incremental.score_arrivals(stream, run, str(tmp_path / "out"))
    quarantined = {r[S.ID]: r["violations"] for r in spark.read.parquet(bad).collect()}
    assert quarantined["id0003"] == ["region is missing"] and quarantined[None] == [f"{S.ID} is missing"]
    got = spark.read.parquet(scored)
    good = rows.filter(F.col(S.ID).isNotNull() & F.col("region").isNotNull() & (F.col("account_age_days") >= 0))
    batch = scored_records(run.score(good)).withColumn("model_run_id", F.lit("r1"))
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()
    # a second start finds nothing new
    again = spark.readStream.schema(rows.schema).parquet(source)
    incremental.score_arrivals(again, run, str(tmp_path / "out"))
    assert spark.read.parquet(scored).count() == batch.count()


def test_stream_scores_each_id_once(spark, population, linear, tmp_path):
    rows = population.drop(S.LABEL)
    run = runs.ScoringRun("r1", linear, {"high_from": 0.6, "medium_from": 0.3}, linear)
    for part in (rows, rows.limit(90)):  # the second part arrives after a restart
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        scored, bad = incremental.score_arrivals(stream, run, str(tmp_path / "out"), remember_days=7)
    valid = incremental.checked_stream(rows).filter(F.size("violations") == 0).drop("violations")
    batch = scored_records(run.score(valid)).withColumn("model_run_id", F.lit("r1"))
    got = spark.read.parquet(scored)
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()
    assert spark.read.parquet(bad).count() == rows.count() - batch.count() + 90


def test_customer_files(spark, population, tmp_path):
    path = str(tmp_path / "customers.csv")
    population.select(*reversed(population.columns)).write.option("header", True).csv(path)
    read = tables.read_customers(spark, path).select(population.columns)
    assert read.exceptAll(population).count() == 0 and read.schema == population.schema
    with pytest.raises(tables.TableNotFoundError):
        tables.read_customers(spark, str(tmp_path / "absent.csv"))
    nan = spark.createDataFrame([(float("nan"),)], "monthly_spend double")
    assert tables.nan_to_null(nan).first()[0] is None


def test_fingerprint_ignores_order_but_not_duplicates(population):
    one = tables.table_fingerprint(population).first()
    assert one == tables.table_fingerprint(population.repartition(9)).first()
    assert one != tables.table_fingerprint(population.limit(239)).first()
    pair = population.limit(1).union(population.limit(1))
    assert tuple(one) != tuple(tables.table_fingerprint(population.union(pair)).first())


def test_rows_without_an_id_are_numbered_from_zero(spark, population):
    from ebbtide.operators.scoring import with_identifier

    bare = population.drop(S.ID).repartition(5, "region", "monthly_spend")
    numbered = with_identifier(bare)
    first = {r[S.ID]: tuple(r) for r in numbered.collect()}
    assert sorted(first) == list(range(240))
    assert {r[S.ID]: tuple(r) for r in numbered.collect()} == first  # a second reading agrees
    assert with_identifier(bare.limit(0)).count() == 0


def test_ablation_sums_the_columns_up_once(population, monkeypatch):
    settings = models.TrainingSettings(models=("logistic_regression",), folds=2, repeats=1)
    train, _ = training.split_base(population, settings)
    subsets = {"a": (("monthly_spend",), ()), "b": (("monthly_spend", "days_since_last_login"), ("region",))}
    alone = {}
    for name, (numeric, categorical) in subsets.items():
        chosen = replace(settings, numeric=numeric, categorical=categorical)
        alone[name] = training.fold_summary(training.bakeoff(train, chosen)).first()["cv_auc_mean"]
    made = []
    first = models.FoldStatistics
    monkeypatch.setattr(models, "FoldStatistics", lambda *a, **k: made.append(1) or first(*a, **k))
    rows = training.ablation(train, settings, subsets).collect()
    assert len(made) == 1
    assert {r["subset"]: r["cv_auc_mean"] for r in rows} == alone


def test_linear_fits_of_all_splits_share_their_passes(population, monkeypatch):
    """Optima equal those of single fits; the number of passes does not grow with the number of splits."""
    from ebbtide.operators import linear

    settings = replace(SMALL, models=("logistic_regression",), folds=3)
    train, _ = training.split_base(population, settings)
    prepared = training.prepare_everything(train, settings)
    plan = [prepared[s.key] for group in training.out_of_fold_splits(settings).values() for s in group]
    passes = []
    monkeypatch.setattr(models.linear, "_summed", lambda *a, first=linear._summed: passes.append(1) or first(*a))
    members = models.fit_members(train, plan, "logistic_regression", settings)
    assert len(members) == 9 and len(passes) < 25
    for p, ((prep, model, sigmoid), *_) in zip(plan, members):
        rows = prep.transform(train.filter(p.split.fit)).select(vector_to_array(prep.getOutputCol()).alias("x"), S.LABEL).collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r[S.LABEL] for r in rows], dtype=float)
        w, b = model.coefficients.toArray(), model.intercept
        score = 1 / (1 + np.exp(-(x @ w + b)))
        assert len(rows) == p.rows and np.abs(x.T @ (score - y) + w).max() < 1e-6 and abs((score - y).sum()) < 1e-6
        held = model.transform(prep.transform(train.filter(p.split.hold)))
        value = F.element_at(vector_to_array(F.col(sigmoid.getOrDefault("inputCol"))), 2)
        slope, intercept = models.fit_sigmoid(held, value, p.hold_positive, p.hold_negative)
        assert (sigmoid.getOrDefault("slope"), sigmoid.getOrDefault("intercept")) == pytest.approx((slope, intercept), abs=1e-3)


def test_linear_fit_of_one_class_and_of_equal_margins(population):
    settings = replace(SMALL, models=("logistic_regression",))
    train, _ = training.split_base(population.withColumn(S.LABEL, F.lit(1)), settings)
    whole = models.prepare_splits(train, [training.whole_split()], settings)["all"]
    model = models.fit_on_splits(train, [("logistic_regression", whole)], settings)[0]
    assert {r[SCORE] for r in models.positive_probability(model, train).collect()} == {1.0}
    # margins without any spread: the sigmoid has no slope and the share of positives as its level
    constant = population.withColumns({c: F.lit(None).cast(dict(population.dtypes)[c]) for c in S.NUMERIC}).withColumns(
        {c: F.lit("one") for c in S.CATEGORICAL}
    )
    train, _ = training.split_base(constant, settings)
    plan = training.calibration_splits(settings)
    prepared = models.prepare_splits(train, plan, settings)
    for p, (stages, *_) in zip(plan, models.fit_members(train, [prepared[p.key] for p in plan], "logistic_regression", settings)):
        pos, neg = prepared[p.key].hold_positive, prepared[p.key].hold_negative
        level = (pos * (pos + 1) / (pos + 2) + neg / (neg + 2)) / (pos + neg)
        assert stages[2].getOrDefault("slope") == 0.0
        assert stages[2].getOrDefault("intercept") == pytest.approx(np.log(level / (1 - level)), abs=1e-6)


@pytest.mark.parametrize("name", ["random_forest", "hist_gradient_boosting"])
def test_sigmoids_of_trees_share_their_passes(population, monkeypatch, name):
    """Sigmoids are the soft-target optima of the held-out margins, found by a few passes for all members together."""
    from ebbtide.operators import linear

    settings = replace(SMALL, models=(name,), folds=2)
    train, _ = training.split_base(population, settings)
    prepared = training.prepare_everything(train, settings)
    plan = [prepared[s.key] for group in training.out_of_fold_splits(settings).values() for s in group]
    passes = []
    monkeypatch.setattr(linear, "_summed", lambda *a, first=linear._summed: passes.append(1) or first(*a))
    members = models.fit_members(train, plan, name, settings)
    assert len(members) == 4 and 0 < len(passes) < 20
    for p, ((prep, model, sigmoid), *_) in zip(plan, members):
        value = F.element_at(vector_to_array(F.col(sigmoid.getOrDefault("inputCol"))), 2)
        rows = model.transform(prep.transform(train.filter(p.split.hold))).select(value.alias("x"), S.LABEL).collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r[S.LABEL] for r in rows])
        assert (y.sum(), (1 - y).sum()) == (p.hold_positive, p.hold_negative)
        target = np.where(y == 1, (p.hold_positive + 1) / (p.hold_positive + 2), 1 / (p.hold_negative + 2))
        slope, intercept = sigmoid.getOrDefault("slope"), sigmoid.getOrDefault("intercept")
        score = 1 / (1 + np.exp(-(slope * x + intercept)))
        assert abs(((score - target) * x).sum()) < 1e-3 and abs((score - target).sum()) < 1e-3


def test_saved_run_query_fits_with_the_whole_budget(spark, population, monkeypatch):
    asked = []

    def job(df, settings, folder, first=training.train_and_evaluate):
        asked.append(settings)
        return first(df, replace(SMALL, models=("logistic_regression",)), folder)

    monkeypatch.setattr(learning, "_customers", lambda *a: population)
    monkeypatch.setattr(training, "train_and_evaluate", job)
    assert learning.m11_s3_s4_s6_saved_run(spark, "nowhere").count() > 50
    (s,) = asked
    assert s == TrainingSettings() and s.models == tuple(S.MODEL_PREFERENCE)
    assert (s.folds, s.repeats, s.bootstrap_rounds) == (5, 3, 1000)
    assert (s.trees, s.forest_depth, s.boosting_rounds, s.boosting_depth) == (300, 15, 100, 5)
    forest, boosting = (models.classifier(n, 100, s) for n in ("random_forest", "hist_gradient_boosting"))
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (300, 15)
    assert (boosting.getMaxIter(), boosting.getMaxDepth()) == (100, 5)


@pytest.fixture(scope="module")
def forest_folds(population):
    settings = replace(SMALL, models=("random_forest",), repeats=2, parallel_fits=1)
    train, _ = training.split_base(population, settings)
    return settings, train, training.prepare_everything(train, settings)


def test_forests_are_dropped_once_their_folds_are_scored(forest_folds, monkeypatch):
    settings, train, prepared = forest_folds
    made, alive = weakref.WeakSet(), []

    def fit(*a, first=models.fit_on_split):
        gc.collect()
        alive.append(len(made))
        made.add(model := first(*a))
        return model

    monkeypatch.setattr(models, "fit_on_split", fit)
    scores = training.fold_scores(train, settings, prepared)
    monkeypatch.undo()
    assert len(alive) == 4 and max(alive) <= 1
    for r in range(2):
        for f in range(2):
            model = models.fit_on_split(train, prepared[f"cv_{r}_{f}"], "random_forest", settings)
            held = models.positive_probability(model, train.filter(F.col(f"fold_{r}") == f)).select(S.ID, SCORE)
            own = scores.filter((F.col("repeat") == r) & (F.col("fold") == f)).select(S.ID, SCORE)
            assert sorted(map(tuple, own.collect())) == sorted(map(tuple, held.collect()))


def test_members_of_an_outer_fold_are_dropped_once_it_is_scored(forest_folds, monkeypatch):
    settings, train, _ = forest_folds
    made, alive = weakref.WeakSet(), []

    def fit(*a, first=models._fit_member):
        gc.collect()
        alive.append(len(made))
        fitted = first(*a)
        made.add(fitted[1])
        return fitted

    settings = replace(settings, folds=4)
    train, _ = training.split_base(train.select(S.ID, S.LABEL, *S.RAW_FEATURES), settings)
    prepared = training.prepare_everything(train, settings)
    monkeypatch.setattr(models, "_fit_member", fit)
    got = {r[S.ID]: r[SCORE] for r in training.out_of_fold_scores(train, "random_forest", settings, prepared).collect()}
    assert len(alive) == 16 and max(alive) < 9 and len(got) == train.count()
    group = [prepared[s.key] for s in training.out_of_fold_splits(settings)[2]]
    alone = models.average_of(models.fit_members(train, group, "random_forest", settings))
    want = {r[S.ID]: r[SCORE] for r in models.positive_probability(alone, train.filter("oof_fold = 2")).collect()}
    assert want and {i: got[i] for i in want} == want


def test_results_come_in_the_order_of_the_tasks_and_errors_are_raised(spark):
    import time

    def late(i):
        time.sleep(0.02 * (5 - i))
        return i

    assert list(models.in_turn(spark, [lambda i=i: late(i) for i in range(5)], 3)) == [0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        list(models.in_turn(spark, [lambda: 1, lambda: 1 // 0, lambda: 2], 2))
