"""Batch scoring with frozen tiers and per-row reasons: one narrow stage, no shuffle."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import risk_tier
from ebbtide.operators.explain import prep_of, prepared_rows, reason_expression
from ebbtide.operators.models import SCORE, positive_probability
from ebbtide.session import materialized


#: ``monotonically_increasing_id`` has the task in its upper bits and counts rows in these.
_ROW_BITS = 33


def with_identifier(df: DataFrame) -> DataFrame:
    """Rows without an id column are numbered 0 .. n-1, in the order of the input's partitions.

    Rows are written once with their task and place in it; a task's first number is the number of rows in the tasks
    before it. Nothing is sorted, and what the numbers come from is fixed, so a second reading gives the same ones. On a
    stream, where the rows before are not known, numbers are unique in a batch but not consecutive.
    """
    if S.ID in df.columns:
        return df
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    if df.isStreaming:
        return marked.withColumnRenamed("_at", S.ID)
    marked = materialized(marked, "numbered")
    task = F.shiftright("_at", _ROW_BITS)
    sizes = marked.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    # One row for each task.
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = marked.withColumn("_task", task).join(firsts, "_task")
    place = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.withColumn(S.ID, F.col("_first") + place).drop("_at", "_task", "_first")


def score_frame(df: DataFrame, model: PipelineModel, t_star, t_mid, base_linear: PipelineModel | None = None,
                k=S.REASONS) -> DataFrame:
    """Id, score and tier, plus reasons when a linear base model exists. Other columns are not used."""
    scored = positive_probability(model, with_identifier(df).drop(S.LABEL), SCORE)
    columns = [S.ID, SCORE, risk_tier(F.col(SCORE), t_star, t_mid).alias("risk_tier")]
    if base_linear is not None:
        scored = prepared_rows(base_linear, scored)
        features = prep_of(base_linear).getOutputCol()
        columns.append(reason_expression(base_linear, features, k).alias("top_reason_codes"))
    return scored.select(*columns)


def scored_records(scored: DataFrame) -> DataFrame:
    """The scored table in its fixed output schema; a renamed column fails here."""
    optional = {"top_reason_codes"}
    absent = [f.name for f in S.SCORED_SCHEMA if f.name not in scored.columns and f.name not in optional]
    if absent:
        raise ValueError(f"scored table lacks {absent}")
    return scored.select(
        *[
            (F.col(f.name) if f.name in scored.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.SCORED_SCHEMA
        ]
    )
