"""Classifiers, sigmoid calibration and score stages that persist as ordinary ``pyspark.ml`` pipelines."""

from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators import linear
from ebbtide.operators.foldstats import FoldStatistics, Scheme
from ebbtide.operators.prep import (
    DerivedFeatures,
    FeaturePrep,
    FeaturePrepModel,
    RangeRepair,
    add_derived_features,
    repair_ranges,
)
from ebbtide.session import materialized

SCORE = "churn_probability"


@dataclass(frozen=True)
class TrainingSettings:
    """Budget and seeds of a training run. Smaller budgets are set here, never in code."""

    seed: int = S.SEED
    holdout_share: float = S.HOLDOUT_SHARE
    folds: int = S.FOLDS
    repeats: int = S.REPEATS
    models: tuple = tuple(S.MODEL_PREFERENCE)
    inverse_penalty: float = 1.0
    max_iterations: int = 2000
    trees: int = 300
    forest_depth: int = 15
    boosting_rounds: int = 100
    boosting_depth: int = 5
    bootstrap_rounds: int = S.BOOTSTRAP_ROUNDS
    parallel_fits: int = 8
    numeric: tuple = tuple(S.MODEL_NUMERIC)
    categorical: tuple = tuple(S.CATEGORICAL)
    scenarios: dict = field(default_factory=lambda: dict(S.SCENARIOS))


def classifier(name, rows, settings: TrainingSettings, features="features", suffix=""):
    """An unfitted classifier. The penalty of the linear model depends on the number of training rows."""
    columns = dict(
        featuresCol=features,
        labelCol=S.LABEL,
        rawPredictionCol=f"raw{suffix}",
        probabilityCol=f"probability{suffix}",
        predictionCol=f"prediction{suffix}",
    )
    if name == "logistic_regression":
        return LogisticRegression(
            regParam=1.0 / (settings.inverse_penalty * max(rows, 1)),
            elasticNetParam=0.0,
            standardization=False,  # otherwise the penalty of the 0/1 columns would be rescaled
            maxIter=settings.max_iterations,
            tol=1e-6,
            **columns,
        )
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=settings.trees,
            maxDepth=settings.forest_depth,
            featureSubsetStrategy="sqrt",
            cacheNodeIds=True,  # the same trees; otherwise every level walks every tree from its root
            seed=settings.seed,
            **columns,
        )
    if name == "hist_gradient_boosting":
        return (
            GBTClassifier(
                featuresCol=features,
                labelCol=S.LABEL,
                predictionCol=f"prediction{suffix}",
                maxIter=settings.boosting_rounds,
                stepSize=0.1,
                maxDepth=settings.boosting_depth,
                minInstancesPerNode=20,
                maxBins=255,
                seed=settings.seed,
            )
            .setRawPredictionCol(f"raw{suffix}")
            .setProbabilityCol(f"probability{suffix}")
        )
    raise ValueError(f"unknown model {name!r}")


def pipeline(name, rows, settings=TrainingSettings()) -> Pipeline:
    """Repair, derive, prepare and classify as one unfitted pipeline."""
    return Pipeline(
        stages=[
            RangeRepair(),
            DerivedFeatures(),
            FeaturePrep(numeric=list(settings.numeric), categorical=list(settings.categorical)),
            classifier(name, rows, settings),
        ]
    )


def stateless_features(df: DataFrame) -> DataFrame:
    """The part of preparation that learns nothing, so that all folds can share it."""
    return add_derived_features(repair_ranges(df))


@dataclass(frozen=True)
class Split:
    """One training split: which rows a model is fitted on and which rows it is held out from.

    ``fold`` deals the rows of the split's ``scheme`` to folds; the split leaves ``left_out`` out (None: nothing).
    """

    key: str
    fit: Column
    hold: Column
    scheme: str
    fold: Column
    left_out: int | None = None


@dataclass(frozen=True)
class PreparedSplit:
    split: Split
    prep: FeaturePrepModel
    rows: int
    hold_positive: int
    hold_negative: int


def learned_folds(base: DataFrame, splits: list[Split], numeric, categorical) -> FoldStatistics:
    """Summaries of the splits' fold schemes, for any of the columns."""
    schemes = {s.scheme: Scheme(s.scheme, s.fold) for s in splits}
    return FoldStatistics(base, list(schemes.values()), numeric, categorical)


def prepare_splits(base: DataFrame, splits: list[Split], settings: TrainingSettings, learned=None) -> dict[str, PreparedSplit]:
    """Preparation statistics and sizes of all splits, learned together.

    Rows are summed up once for each fold scheme; a split is its scheme's sums without those of one fold. ``learned``
    may hold the summaries of these splits, for more columns than the settings name.
    """
    learned = learned or learned_folds(base, splits, settings.numeric, settings.categorical)
    place = {scheme.key: i for i, scheme in enumerate(learned.schemes)}
    prepared = {}
    for s in splits:
        at = place[s.scheme]
        statistics = learned.statistics(at, s.left_out).only(settings.numeric, settings.categorical).to_json()
        held = (0, 0) if s.left_out is None else learned.fold_labels(at, s.left_out)
        prepared[s.key] = PreparedSplit(s, FeaturePrepModel(statistics=statistics), learned.sizes(at, s.left_out), *held)
    return prepared


def in_turn(spark, tasks, workers):
    """Run driver-side fit calls side by side; each one submits its own distributed jobs.

    Results come in the order of the tasks and are not kept once they are handed out.
    """
    if workers <= 1 or len(tasks) <= 1:
        yield from (t() for t in tasks)
        return
    with ThreadPoolExecutor(workers) as pool:
        waiting = deque(pool.submit(inheritable_thread_target(spark)(t)) for t in tasks)
        try:
            while waiting:
                yield waiting.popleft().result()
        finally:
            for future in waiting:
                future.cancel()


def fit_on_split(base: DataFrame, prepared: PreparedSplit, name, settings) -> PipelineModel:
    """A fitted pipeline for one split; ``base`` already went through ``stateless_features``."""
    train = prepared.prep.transform(base.filter(prepared.split.fit)).select("features", S.LABEL)
    model = classifier(name, prepared.rows, settings).fit(train)
    return PipelineModel([RangeRepair(), DerivedFeatures(), prepared.prep, model])


def _solved(base: DataFrame, prepared: list[PreparedSplit], name, settings, calibrate=False):
    """Weights of all splits, and the sigmoids on their held-out rows, from shared passes; None if fitted one by one."""
    if name != "logistic_regression" or not prepared:
        return None
    statistics = [p.prep.learned for p in prepared]
    layout = linear.layout_of(statistics)
    if layout.size > linear.MAX_COLUMNS or not all(s.feature_names() for s in statistics):
        return None
    rows = linear.rows_of(base, layout, [p.split for p in prepared]).persist()
    try:
        weights = linear.fit_weights(rows, layout, statistics, settings)
        return weights, linear.fit_sigmoids(rows, layout, prepared, statistics, weights) if calibrate else None
    finally:
        rows.unpersist()


def fit_on_splits(base: DataFrame, tasks: list[tuple], settings, use=None) -> list:
    """Fitted pipelines of (model name, prepared split) pairs; the linear ones share their passes over the rows.

    With ``use``, ``use(i, model)`` is called as soon as the model of task ``i`` is fitted, and its results are returned:
    large models that it does not keep are gone before the next ones are fitted.
    """
    use = use or (lambda i, model: model)
    own = [p for name, p in tasks if name == "logistic_regression"]
    solved = _solved(base, own, "logistic_regression", settings)
    weights = iter(solved[0] if solved else [])
    rest = [i for i, (name, _) in enumerate(tasks) if solved is None or name != "logistic_regression"]
    calls = [lambda i=i: use(i, fit_on_split(base, tasks[i][1], tasks[i][0], settings)) for i in rest]
    out = dict(zip(rest, in_turn(base.sparkSession, calls, settings.parallel_fits)))
    for i, (name, p) in enumerate(tasks):
        if i not in out:
            model = linear.as_model(base.sparkSession, classifier(name, p.rows, settings), next(weights))
            out[i] = use(i, PipelineModel([RangeRepair(), DerivedFeatures(), p.prep, model]))
    return [out[i] for i in range(len(tasks))]


def positive_probability(model: PipelineModel, df: DataFrame, output=SCORE) -> DataFrame:
    """Add the score of a fitted pipeline as a plain double column."""
    last = model.stages[-1]
    if isinstance(last, MeanScore):
        scored = model.transform(df)
        return scored if output == last.getOrDefault(last.outputCol) else scored.withColumnRenamed(
            last.getOrDefault(last.outputCol), output
        )
    extra = [last.getFeaturesCol(), last.getRawPredictionCol(), last.getPredictionCol()]
    scored = model.transform(df)
    return scored.withColumn(
        output, F.element_at(vector_to_array(F.col(last.getProbabilityCol())), 2)
    ).drop(*extra, last.getProbabilityCol())


class SigmoidScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """1 / (1 + exp(-(slope * x + intercept))) on the second entry of a vector column."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "score column", TypeConverters.toString)
    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, slope=1.0, intercept=0.0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        x = F.element_at(vector_to_array(F.col(self.getOrDefault(self.inputCol))), 2)
        margin = F.lit(self.getOrDefault(self.slope)) * x + F.lit(self.getOrDefault(self.intercept))
        return dataset.withColumn(self.getOrDefault(self.outputCol), 1.0 / (1.0 + F.exp(-margin)))


class MeanScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Average of several score columns; working columns are dropped."""

    inputCols = Param(Params._dummy(), "inputCols", "score columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "mean column", TypeConverters.toString)
    working = Param(Params._dummy(), "working", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=SCORE, working=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._set(outputCol=outputCol)

    def _transform(self, dataset):
        names = self.getOrDefault(self.inputCols)
        total = F.col(names[0])
        for name in names[1:]:
            total = total + F.col(name)
        out = dataset.withColumn(self.getOrDefault(self.outputCol), total / F.lit(float(len(names))))
        return out.drop(*names, *self.getOrDefault(self.working))


def fit_sigmoid(scored: DataFrame, value: Column, positive, negative) -> tuple[float, float]:
    """Slope and intercept of a sigmoid on soft targets (N+ + 1)/(N+ + 2) and 1/(N- + 2).

    A row with target t counts as a positive of weight t and a negative of weight 1 - t, which is the same
    likelihood, so that the plain weighted linear model finds the optimum.
    """
    high, low = (positive + 1.0) / (positive + 2.0), 1.0 / (negative + 2.0)
    target = F.when(F.col(S.LABEL) == 1, F.lit(high)).otherwise(F.lit(low))
    parts = F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias("weight")),
    )
    soft = scored.select(array_to_vector(F.array(value)).alias("x"), F.inline(parts))
    model = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", regParam=0.0, maxIter=200, tol=1e-8
    ).fit(soft)
    return float(model.coefficients[0]), float(model.intercept)


def _fit_member(base, prepared: PreparedSplit, name, settings, suffix):
    """Preparation and model of one split, and the column whose second entry is calibrated."""
    features = f"features{suffix}"
    prep = FeaturePrepModel(statistics=prepared.prep.getOrDefault("statistics"), outputCol=features)
    train = prep.transform(base.filter(prepared.split.fit)).select(features, S.LABEL)
    model = classifier(name, prepared.rows, settings, features, suffix).fit(train)
    return prep, model, f"probability{suffix}" if name == "random_forest" else f"raw{suffix}"


def _calibrated_members(base, members, fitted):
    """Members with their sigmoids: held-out margins of all models are written once, and all sigmoids share passes."""
    margins = None
    for i, (prepared, (prep, model, source)) in enumerate(zip(members, fitted)):
        held = model.transform(prep.transform(base.filter(prepared.split.hold)))
        x = F.element_at(vector_to_array(F.col(source)), 2)
        own = held.select(F.lit(i).alias("i"), x.alias("x"), F.col(S.LABEL).cast("double").alias("y"))
        margins = own if margins is None else margins.unionByName(own)
    sigmoids = linear.fit_margin_sigmoids(materialized(margins, "margins"), members)
    out = []
    for i, ((prep, model, source), (slope, intercept)) in enumerate(zip(fitted, sigmoids)):
        score = f"score_{i}"
        stage = SigmoidScore(inputCol=source, outputCol=score, slope=slope, intercept=intercept)
        working = [f"{c}_{i}" for c in ("features", "raw", "probability", "prediction")]
        out.append(([prep, model, stage], score, working))
    return out


def _linear_members(base, members, name, settings, weights, sigmoids):
    out = []
    for i, (prepared, own, (slope, intercept)) in enumerate(zip(members, weights, sigmoids)):
        features, score, source = f"features_{i}", f"score_{i}", f"raw_{i}"
        prep = FeaturePrepModel(statistics=prepared.prep.getOrDefault("statistics"), outputCol=features)
        model = linear.as_model(base.sparkSession, classifier(name, prepared.rows, settings, features, f"_{i}"), own)
        stage = SigmoidScore(inputCol=source, outputCol=score, slope=slope, intercept=intercept)
        out.append(([prep, model, stage], score, [features, source, f"probability_{i}", f"prediction_{i}"]))
    return out


def fit_groups(base: DataFrame, groups: list[list[PreparedSplit]], name, settings):
    """Fitted and calibrated members of every group, one per split, group by group; all are fitted side by side.

    Of tree models only those of the group that was handed out last and of those in work are held.
    """
    every = [m for group in groups for m in group]
    solved = _solved(base, every, name, settings, calibrate=True)
    if solved is not None:
        members = iter(_linear_members(base, every, name, settings, *solved))
        yield from (list(islice(members, len(group))) for group in groups)
        return
    places = [(i, m) for group in groups for i, m in enumerate(group)]
    calls = [lambda i=i, m=m: _fit_member(base, m, name, settings, f"_{i}") for i, m in places]
    fitted = in_turn(base.sparkSession, calls, settings.parallel_fits)
    for group in groups:
        yield _calibrated_members(base, group, list(islice(fitted, len(group))))


def fit_members(base: DataFrame, members: list[PreparedSplit], name, settings) -> list:
    """Fitted and calibrated members, one per split, side by side."""
    return next(fit_groups(base, [members], name, settings))


def average_of(members: list) -> PipelineModel:
    """One flat PipelineModel whose score is the mean of its members' calibrated scores.

    Being flat, it is saved, loaded and applied to streams like any other pipeline.
    """
    stages = [RangeRepair(), DerivedFeatures()]
    scores, working = [], []
    for member, score, used in members:
        stages += member
        scores.append(score)
        working += used
    return PipelineModel([*stages, MeanScore(inputCols=scores, outputCol=SCORE, working=working)])


def fit_calibrated(base: DataFrame, members: list[PreparedSplit], name, settings) -> PipelineModel:
    """Per split: fit on one part, calibrate on the other; the model's score is the mean over the splits."""
    return average_of(fit_members(base, members, name, settings))


def fold_splits(column, folds, within=None, prefix="") -> list[Split]:
    """Leave-one-fold-out splits of a fold column, optionally inside a subset of the rows."""
    inside = F.lit(True) if within is None else within
    fold = F.when(inside, F.col(column))
    return [
        Split(f"{prefix}{f}", inside & (F.col(column) != f), inside & (F.col(column) == f), prefix, fold, f)
        for f in range(folds)
    ]
