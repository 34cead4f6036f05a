"""Row-level expressions for cleaning, features, tiers and reasons."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide import settings as S


def number_or_null(column) -> Column:
    """Cast to double; text that is no number and NaN both become NULL."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def without_nan(df):
    """The table with NaN as NULL in its floating-point columns, so that every count of missing values agrees."""
    floating = [c for c, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floating}) if floating else df


def outside(value: Column, low, high) -> Column:
    """True where a present value lies strictly outside the inclusive range."""
    tests = []
    if low is not None:
        tests.append(value < F.lit(float(low)))
    if high is not None:
        tests.append(value > F.lit(float(high)))
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def repaired(column, low, high) -> Column:
    """The value as double, or NULL when it lies outside its range."""
    value = number_or_null(column)
    if low is None and high is None:
        return value
    return F.when(~outside(value, low, high), value)


def clipped(value: Column, low: Column, high: Column) -> Column:
    """Clip a value; NULL stays NULL (``least``/``greatest`` alone would fill it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def recency_ratio() -> Column:
    return F.try_divide(F.col("days_since_last_login"), F.col("account_age_days") + F.lit(1.0))


def is_dormant(after_days=S.DORMANT_AFTER_DAYS) -> Column:
    return (F.col("days_since_last_login") > F.lit(after_days)).cast("double")


def support_per_order() -> Column:
    orders = F.coalesce(F.col("num_orders_last_90d"), F.lit(0)) + F.lit(1.0)
    return F.try_divide(F.col("support_tickets_raised"), orders)


def risk_tier(score: Column, t_star, t_mid) -> Column:
    """high / medium / low from fixed cut points; a missing score is low."""
    known = score.isNotNull() & ~F.isnan(score)
    return (
        F.when(known & (score >= t_star), "high")
        .when(known & (score >= t_mid), "medium")
        .otherwise("low")
    )


def drift_band(psi: Column) -> Column:
    return (
        F.when(psi < S.PSI_WATCH, "stable")
        .when(psi <= S.PSI_INVESTIGATE, "watch")
        .otherwise("investigate")
    )


def grid_step(score: Column) -> Column:
    """Largest k in 0..100 with ``k * 0.01 <= score``; NULL for scores below zero or missing.

    ``floor`` gives a first guess that can be off by one in floating point; the two comparisons against the
    grid value itself put it right.
    """
    guess = F.floor(F.least(score, F.lit(1.0)) * 100.0)  # infinity has no whole part
    step = (
        F.when((guess + 1) * F.lit(0.01) <= score, guess + 1)
        .when(guess * F.lit(0.01) > score, guess - 1)
        .otherwise(guess)
    )
    return F.when((score >= 0.0) & ~F.isnan(score), F.least(step, F.lit(100)).cast("int"))


def interior_edges_at_or_below(value: Column, edges) -> Column:
    """Number of sorted ``edges`` that are <= ``value``, as a balanced tree of comparisons."""

    def tree(low, high):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(edges[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges))


def interior_edges_below(value: Column, edges) -> Column:
    """Number of sorted ``edges`` that are strictly < ``value``."""

    def tree(low, high):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(edges[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges))


def double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def contributions(standardized: Column, coefficients) -> Column:
    """Coefficient times standardized value, position by position."""
    return F.zip_with(standardized, double_array(coefficients), lambda x, c: x * c)


def reason_codes(contribution: Column, names, k=S.REASONS) -> Column:
    """The k strongest contributions as ``name(+)`` / ``name(-)``; ties go to the earlier feature."""
    labels = F.array(*[F.lit(n) for n in names])
    ranked = F.array_sort(
        F.transform(
            contribution,
            lambda v, i: F.struct((-F.abs(v)).alias("weight"), i.alias("position"), v.alias("signed")),
        )
    )
    texts = F.transform(
        F.slice(ranked, 1, k),
        lambda e: F.concat(
            F.element_at(labels, e["position"] + 1), F.when(e["signed"] >= 0, "(+)").otherwise("(-)")
        ),
    )
    return F.array_join(texts, "; ")


def shuffled_order(identifier, seed) -> Column:
    """A seeded 64-bit order for a row; the same id and seed always give the same place."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.xxhash64(F.lit(int(seed)), column.cast("string"))
