"""Campaign economics: value curve on a fixed threshold grid, cut points and scenario sensitivity.

One pass counts positives and negatives per grid step; every threshold, scenario and hold-out value is then
worked out on the 101 grid rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import grid_step, interior_edges_at_or_below, number_or_null, risk_tier
from ebbtide.operators.ordering import order_values
from ebbtide.session import small_table

STEPS = 101


def campaign_value(tp, fp, cost, value, uplift) -> Column:
    return tp * uplift * value - (tp + fp) * cost


def break_even(cost, value, uplift) -> Column:
    """Score above which a contact pays on average; may exceed 1."""
    return F.try_divide(cost, value * uplift)


def scenario_table(spark: SparkSession, scenarios=None) -> DataFrame:
    rows = [(n, *map(float, p)) for n, p in (scenarios or S.SCENARIOS).items()]
    return small_table(spark, rows, "scenario string, cost double, value double, uplift double")


def grid_counts(df: DataFrame, score, label=S.LABEL, by=(), grid=None) -> DataFrame:
    """True and false positives at each threshold, per group: 0, 0.01 ... 1, or an own ascending ``grid``.

    Rows without a score (NULL, NaN) or below the lowest threshold are contacted at none.
    """
    by = list(by)
    thresholds = [float(t) for t in grid] if grid is not None else None
    if thresholds is None:
        step, n_steps, at = grid_step(F.col(score)), STEPS, F.col("step") * F.lit(0.01)
    else:
        if thresholds != sorted(set(thresholds)) or not thresholds:
            raise ValueError("a grid has ascending, distinct thresholds")
        value, n_steps = number_or_null(score), len(thresholds)
        reached = F.when(value.isNotNull(), interior_edges_at_or_below(value, thresholds) - 1)
        step = F.when(reached >= 0, reached)
        at = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("step") + 1)
    steps = df.select(*by, step.alias("step"), F.col(label).alias("_y"))
    counted = steps.groupBy(*by, "step").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
    )
    grid = df.sparkSession.range(n_steps).select(F.col("id").cast("int").alias("step"))
    if by:
        # groups x fixed grid rows, not a pairing of data rows
        grid = counted.select(*by).distinct().withColumn(
            "step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))
        )
    full = grid.join(counted, [*by, "step"], "left")
    reverse = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = reverse.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select(
        *by,
        "step",
        at.alias("threshold"),
        F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("fp"),
    )


def value_curve(counts: DataFrame, cost, value, uplift) -> DataFrame:
    """Campaign value at every grid threshold."""
    return counts.withColumn(
        "ev", campaign_value(F.col("tp"), F.col("fp"), F.lit(cost), F.lit(value), F.lit(uplift))
    )


def scenario_curves(counts: DataFrame, scenarios=None) -> DataFrame:
    """The value curve of each scenario, from the same grid rows."""
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(float(cost)).alias("cost"),
                F.lit(float(value)).alias("value"),
                F.lit(float(uplift)).alias("uplift"),
            )
            for name, (cost, value, uplift) in (scenarios or S.SCENARIOS).items()
        ]
    )
    return counts.select("*", F.inline(listed)).withColumn(
        "ev", campaign_value(F.col("tp"), F.col("fp"), F.col("cost"), F.col("value"), F.col("uplift"))
    )


def best_threshold(curve: DataFrame, by=()) -> DataFrame:
    """The lowest threshold that reaches the highest campaign value, per group."""
    by = list(by)
    best = F.max(F.struct(F.col("ev"), (-F.col("step")).alias("_s"), F.col("threshold")))
    return curve.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.threshold").alias("t_star"), F.col("_b.ev").alias("best_ev")
    )


@dataclass(frozen=True)
class CutPoints:
    """A fitted campaign threshold with its tier boundary."""

    cost: float
    value: float
    uplift: float
    t_star: float
    t_mid: float
    best_ev: float

    @property
    def break_even(self):
        gain = self.value * self.uplift
        return self.cost / gain if gain else None


def middle_cut(df: DataFrame, score, t_star) -> float:
    """Median of the scores strictly below ``t_star``; half of ``t_star`` when there are none."""
    known = F.when(~F.isnan(F.col(score)) & (F.col(score) < t_star), F.col(score).cast("double"))
    found = order_values(df, {"score": known}, {"score": [0.5]})
    return found[0].value if found else t_star / 2.0


def fit_cut_points(df: DataFrame, score, label=S.LABEL, economics=None) -> CutPoints:
    cost, value, uplift = economics or S.SCENARIOS[S.DEFAULT_SCENARIO]
    best = best_threshold(value_curve(grid_counts(df, score, label), cost, value, uplift)).first()
    t_star = best["t_star"]
    return CutPoints(cost, value, uplift, t_star, middle_cut(df, score, t_star), best["best_ev"])


def value_at(df: DataFrame, score, threshold, economics=None, label=S.LABEL, by=()) -> DataFrame:
    """Campaign value at any threshold, on the grid or not."""
    cost, value, uplift = economics or S.SCENARIOS[S.DEFAULT_SCENARIO]
    hit = F.coalesce(number_or_null(score) >= threshold, F.lit(False))
    counted = df.groupBy(*by).agg(
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp")
    )
    return counted.withColumn(
        "ev", campaign_value(F.col("tp"), F.col("fp"), F.lit(cost), F.lit(value), F.lit(uplift))
    )


def sensitivity(validation: DataFrame, holdout: DataFrame, score, label=S.LABEL, scenarios=None,
                holdout_score=None) -> DataFrame:
    """Per scenario: threshold fitted on validation, value per 1,000 scored hold-out rows.

    ``ev_target_per_1k`` contacts the rows at or above the threshold, ``ev_all_per_1k`` contacts everyone.
    """
    economics = ["scenario", "cost", "value", "uplift"]
    fitted = best_threshold(scenario_curves(grid_counts(validation, score, label), scenarios), economics)
    grid = Window.partitionBy(F.lit(0))  # the 101 grid rows
    held = grid_counts(holdout, holdout_score or score, label).withColumns(
        {"tp_all": F.max("tp").over(grid), "fp_all": F.max("fp").over(grid)}
    )
    money = (F.col("cost"), F.col("value"), F.col("uplift"))
    per_1k = F.try_divide(F.lit(1000.0), F.col("tp_all") + F.col("fp_all"))
    return fitted.join(held, fitted["t_star"] == held["threshold"]).select(
        *economics,
        break_even(*money).alias("break_even"),
        "t_star",
        (campaign_value(F.col("tp"), F.col("fp"), *money) * per_1k).alias("ev_target_per_1k"),
        (campaign_value(F.col("tp_all"), F.col("fp_all"), *money) * per_1k).alias("ev_all_per_1k"),
    )


def with_tiers(df: DataFrame, score, cuts: CutPoints) -> DataFrame:
    return df.withColumn("risk_tier", risk_tier(F.col(score), cuts.t_star, cuts.t_mid))


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("risk_tier").agg(F.count("*").alias("customers"))


def contact_list(df: DataFrame, score, customer_value, limit=None, key=S.ID) -> DataFrame:
    """Customers by score times customer value, highest first; ``limit`` is the campaign's size."""
    ranked = df.withColumn("priority", F.col(score) * F.col(customer_value)).orderBy(
        F.col("priority").desc(), F.col(key)
    )
    return ranked.limit(limit) if limit else ranked
