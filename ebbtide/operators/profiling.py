"""Profiling aggregates of a customer table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import outside, without_nan
from ebbtide.operators.ordering import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def shape(df: DataFrame, label=S.LABEL) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.avg(F.col(label).cast("double")).alias("target_rate"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values (NULL or NaN) and how many; complete columns are left out."""
    df = without_nan(df)
    counts = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in df.columns
    ]
    return df.agg(F.array(*counts).alias("_m")).select(F.inline("_m")).filter("missing > 0")


def describe_numeric(df: DataFrame, columns=None, digits=2) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    df = without_nan(df)
    columns = columns or [*S.NUMERIC, S.LABEL]
    moments = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in columns
    ]
    basic = df.agg(F.array(*moments).alias("_m")).select(F.inline("_m"))
    quartiles = (
        exact_quantiles(df, {c: F.col(c) for c in columns}, QUARTILES)
        .groupBy("column")
        .pivot("prob", QUARTILES)
        .agg(F.first("quantile"))
        .toDF("column", "q25", "q50", "q75")
    )
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return basic.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", *[F.round(n, digits).alias(n) for n in numbers]
    )


def segment_rates(df: DataFrame, columns=None, label=S.LABEL, digits=3) -> DataFrame:
    """Attrition rate for every present level of several segment columns in one pass (grouping sets)."""
    columns = columns or ["subscription_plan", "region", "device_type"]
    names = F.array(*[F.lit(c) for c in columns])
    # grouping_id sets one bit per column that is rolled up; the column still grouped has a zero bit
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(i + 1)) for i, c in enumerate(columns)])
    return (
        df.groupingSets([[c] for c in columns], *columns)
        .agg(
            which.alias("_which"),
            F.count("*").alias("customers"),
            F.round(F.avg(F.col(label).cast("double")), digits).alias("target_rate"),
        )
        .select(
            F.element_at(names, F.col("_which")).alias("segment"),
            F.coalesce(*columns).alias("level"),
            "customers",
            "target_rate",
        )
        .filter(F.col("level").isNotNull())
    )


def class_balance(df: DataFrame, label=S.LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("customers")).orderBy(label)


def box_statistics(df: DataFrame, columns=None, capped="monthly_spend", cap_at=0.95, label=S.LABEL) -> DataFrame:
    """Quartiles and whiskers by class; one column is capped at its overall quantile first."""
    df = without_nan(df)
    columns = columns or ["days_since_last_login", "monthly_spend", "support_tickets_raised"]
    values = {c: F.col(c).cast("double") for c in columns}
    if capped in values:
        cap = exact_quantiles(df, {capped: values[capped]}, [cap_at]).first()["quantile"]
        values[capped] = F.when(values[capped].isNotNull(), F.least(values[capped], F.lit(cap)))
    quartiles = (
        exact_quantiles(df, values, QUARTILES, by=[label])
        .groupBy(label, "column")
        .pivot("prob", QUARTILES)
        .agg(F.first("quantile"))
        .toDF(label, "column", "q1", "median", "q3")
    )
    long = df.select(
        label,
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()])),
    ).filter(F.col("value").isNotNull())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        long.join(F.broadcast(quartiles), [label, "column"])
        .groupBy(label, "column", "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("whisker_low"),
            F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("whisker_high"),
        )
    )


def rows_with_missing(df: DataFrame, columns=None) -> DataFrame:
    df = without_nan(df)
    columns = columns or df.columns
    return df.agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in columns])).alias("rows_with_missing"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row in full."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def outlier_profile(df: DataFrame, columns=None, limit=1000.0) -> DataFrame:
    """Median, 99th percentile, maximum and the number of rows above a limit."""
    df = without_nan(df)
    columns = columns or S.CLIPPED
    marks = (
        exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5, 0.99])
        .groupBy("column")
        .pivot("prob", [0.5, 0.99])
        .agg(F.first("quantile"))
        .toDF("column", "median", "p99")
    )
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.count_if(F.col(c) > limit).alias("above_limit"),
        )
        for c in columns
    ]
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c")).join(F.broadcast(marks), "column")


def impossible_rows(df: DataFrame, ranges=None) -> DataFrame:
    """Rows that hold at least one out-of-range value."""
    df = without_nan(df)
    tests = [outside(F.col(c), *r) for c, r in (ranges or S.VALID_RANGES).items() if c in df.columns]
    any_bad = tests[0]
    for test in tests[1:]:
        any_bad = F.coalesce(any_bad, F.lit(False)) | F.coalesce(test, F.lit(False))
    return df.agg(F.count_if(any_bad).alias("impossible_rows"))


def spend_without_orders(df: DataFrame) -> DataFrame:
    """Positive spend with zero recent orders: counted, never repaired, because the windows differ."""
    df = without_nan(df)
    return df.agg(
        F.count_if((F.col("num_orders_last_90d") == 0) & (F.col("monthly_spend") > 0)).alias("spend_without_orders")
    )


def label_correlation(df: DataFrame, columns=None, label=S.LABEL) -> DataFrame:
    """Point-biserial correlation of each numeric column with the label, over rows that have both."""
    df = without_nan(df)
    columns = columns or S.NUMERIC
    pairs = [
        F.struct(
            F.lit(c).alias("column"), F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias("correlation")
        )
        for c in columns
    ]
    return df.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))


def class_medians(df: DataFrame, columns=None, label=S.LABEL) -> DataFrame:
    df = without_nan(df)
    columns = columns or S.NUMERIC
    return exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5], by=[label]).select(
        label, "column", F.col("quantile").alias("median")
    )


def retention_lift(df: DataFrame, arm, label=S.LABEL) -> DataFrame:
    """Retention of treated against control customers, with a normal 95% interval of the difference."""
    kept = 1.0 - F.col(label).cast("double")
    treated, control = F.col(arm) == "treated", F.col(arm) == "control"
    rate_t, rate_c = F.avg(F.when(treated, kept)), F.avg(F.when(control, kept))
    n_t, n_c = F.count_if(treated), F.count_if(control)
    error = F.sqrt(rate_t * (1.0 - rate_t) / n_t + rate_c * (1.0 - rate_c) / n_c)
    sums = df.agg(
        n_t.alias("treated"),
        n_c.alias("control"),
        rate_t.alias("treated_retention"),
        rate_c.alias("control_retention"),
        (rate_t - rate_c).alias("lift"),
        error.alias("_e"),
    )
    return sums.select(
        "treated",
        "control",
        "treated_retention",
        "control_retention",
        "lift",
        (F.col("lift") - 1.96 * F.col("_e")).alias("lift_low"),
        (F.col("lift") + 1.96 * F.col("_e")).alias("lift_high"),
    )
