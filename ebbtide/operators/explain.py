"""Linear explanations: coefficients, contributions, odds ratios and reason codes."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions import columns as X
from ebbtide.operators.prep import FeaturePrepModel
from ebbtide.session import small_table


class NotLinearError(TypeError):
    """The model has no coefficients."""


def prep_of(model: PipelineModel) -> FeaturePrepModel:
    return next(s for s in model.stages if isinstance(s, FeaturePrepModel))


def coefficients_of(model: PipelineModel) -> dict[str, float]:
    """Coefficient per feature name of a fitted linear pipeline."""
    linear = model.stages[-1]
    if not hasattr(linear, "coefficients"):
        raise NotLinearError(f"a linear model is needed, got {type(linear).__name__}")
    return named_coefficients(prep_of(model).feature_names, linear.coefficients.toArray())


def named_coefficients(names, values) -> dict[str, float]:
    values = [float(v) for v in values]
    if len(names) != len(values):
        raise ValueError(f"{len(names)} feature names do not match {len(values)} coefficients")
    return dict(zip(names, values))


def coefficient_table(spark: SparkSession, coefficients: dict[str, float]) -> DataFrame:
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(coefficients.items())]
    return small_table(spark, rows, "position int, feature string, coef double")


def odds_ratios(coefficients: DataFrame, top=None) -> DataFrame:
    """exp(coefficient) per feature, strongest coefficient first."""
    ranked = coefficients.select("feature", "coef", F.exp("coef").alias("odds_ratio")).orderBy(
        F.abs("coef").desc(), F.col("feature")
    )
    return ranked.limit(top) if top else ranked


def prepared_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows after every stage but the last one (the classifier)."""
    for stage in model.stages[:-1]:
        df = stage.transform(df)
    return df


def contributions(model: PipelineModel, df: DataFrame, output="contributions") -> DataFrame:
    """Add the array of coefficient x prepared value, in feature-name order."""
    coefficients = coefficients_of(model)
    prepared = prepared_rows(model, df)
    features = vector_to_array(F.col(prep_of(model).getOutputCol()))
    return prepared.withColumn(output, X.contributions(features, list(coefficients.values())))


def named_contributions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Contributions as one column per feature, beside the id."""
    names = list(coefficients_of(model))
    rows = contributions(model, df, "_c")
    return rows.select(S.ID, *[F.element_at("_c", i + 1).alias(n) for i, n in enumerate(names)])


def reason_expression(model: PipelineModel, features: str, k=S.REASONS):
    coefficients = coefficients_of(model)
    return X.reason_codes(
        X.contributions(vector_to_array(F.col(features)), list(coefficients.values())), list(coefficients), k
    )


def reason_codes(model: PipelineModel, df: DataFrame, k=S.REASONS) -> DataFrame:
    """Id and the k strongest signed contributions per row."""
    prepared = prepared_rows(model, df)
    return prepared.select(
        S.ID, reason_expression(model, prep_of(model).getOutputCol(), k).alias("top_reason_codes")
    )
