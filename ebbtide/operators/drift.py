"""Drift between two tables: PSI and two-sample KS for all features together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import drift_band, interior_edges_at_or_below, number_or_null
from ebbtide.operators import ordering
from ebbtide.session import small_table

EPS = S.PSI_EPSILON


def psi_from_counts(counts: DataFrame, ref="ref", cur="cur", by=()) -> DataFrame:
    """PSI per group from one row per level with the counts of both sides.

    The smoothing constant joins each level's count but only once each side's total, so shares need not add up
    to one. The sum over levels is split so that totals and levels come out of a single aggregate:
    sum((q - p) ln(q / p)) with p = r / R, q = c / C equals
    sum(c ln(c/r)) / C - sum(r ln(c/r)) / R + ln(R / C) (sum(c) / C - sum(r) / R).
    """
    by = list(by)
    r, c = F.col(ref) + EPS, F.col(cur) + EPS
    ratio = F.ln(c / r)
    sums = counts.groupBy(*by).agg(
        F.sum(ref).alias("ref_rows"),
        F.sum(cur).alias("cur_rows"),
        F.sum(r).alias("_r"),
        F.sum(c).alias("_c"),
        F.sum(r * ratio).alias("_rl"),
        F.sum(c * ratio).alias("_cl"),
    )
    whole_r, whole_c = F.col("ref_rows") + EPS, F.col("cur_rows") + EPS
    psi = (
        F.col("_cl") / whole_c
        - F.col("_rl") / whole_r
        + F.ln(whole_r / whole_c) * (F.col("_c") / whole_c - F.col("_r") / whole_r)
    )
    return sums.select(*by, "ref_rows", "cur_rows", psi.alias("psi"))


def both_sides(reference: DataFrame, current: DataFrame, columns) -> DataFrame:
    """The two tables under one another with a ``side`` mark."""
    return reference.select(*columns, F.lit("ref").alias("side")).unionByName(
        current.select(*columns, F.lit("cur").alias("side"))
    )


def _side_counts(side="side"):
    return [F.count_if(F.col(side) == "ref").alias("ref"), F.count_if(F.col(side) == "cur").alias("cur")]


def _long(rows, columns, cast) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), cast(c).alias("value")) for c in columns])
    return rows.select("side", F.inline(entries))


def decile_edges(reference: DataFrame, columns, bins=S.PSI_BINS) -> dict[str, list[float]]:
    """Distinct reference quantiles per numeric column; empty when the column has no values."""
    probs = [i / bins for i in range(bins + 1)]
    found = ordering.order_values(
        reference, {c: number_or_null(c) for c in columns}, {c: probs for c in columns}
    )
    edges = {c: set() for c in columns}
    for value in found:
        edges[value.column].add(value.value)
    return {c: sorted(v) for c, v in edges.items()}


def _numeric_level(edges: dict[str, list[float]]) -> Column:
    """Bin number within the reference deciles, or the value itself when there are too few edges."""
    level = None
    for feature, marks in edges.items():
        if len(marks) < 3:
            text = F.col("value").cast("string")
        else:
            text = interior_edges_at_or_below(F.col("value"), marks[1:-1]).cast("string")
        test = F.col("feature") == feature
        level = F.when(test, text) if level is None else level.when(test, text)
    return level


def _number_cells(reference, current, columns) -> DataFrame:
    """Rows of both sides per (feature, value); text that is no number and missing values are dropped."""
    numbers = _long(both_sides(reference, current, columns), columns, number_or_null)
    return numbers.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(*_side_counts())


def _number_edges(reference, current, columns) -> list[float]:
    numbers = _long(both_sides(reference, current, columns), columns, number_or_null)
    return ordering.value_edges(numbers.filter(F.col("value").isNotNull()), "value")


def cells_ks(cells: DataFrame, edges) -> DataFrame:
    """Largest distance of the two cumulative shares per feature; 0 when one side is empty."""
    totals = ordering.running_totals(cells, ["feature"], "value", ["ref", "cur"], edges)
    gap = F.abs(F.try_divide("ref_upto", "ref_total") - F.try_divide("cur_upto", "cur_total"))
    return totals.groupBy("feature").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def _with_empty_bins(levels: DataFrame, edges) -> DataFrame:
    """Counts per (feature, bin); bins that no row falls into still count in the smoothed sum."""
    empty = [
        (c, str(i), 0, 0) for c, marks in edges.items() if len(marks) >= 3 for i in range(len(marks) - 1)
    ]
    if empty:
        schema = "feature string, level string, ref bigint, cur bigint"
        levels = levels.unionByName(small_table(levels.sparkSession, empty, schema))
    return levels.groupBy("feature", "level").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def binned(cells: DataFrame, edges: dict[str, list[float]]):
    """Counts of both sides per (feature, bin) from cells of values; None if no feature has edges."""
    if not edges:
        return None
    return _with_empty_bins(cells.select("feature", _numeric_level(edges).alias("level"), "ref", "cur"), edges)


def level_counts(reference: DataFrame, current: DataFrame, numeric=(), categorical=(), bins=S.PSI_BINS,
                 cells=None) -> DataFrame:
    """Counts of both sides per (feature, level): bins for numbers, values for categories.

    Numbers fall into their bins before rows are grouped. ``cells`` (rows per value, as the KS statistic needs them)
    are used where they are at hand.
    """
    parts = []
    if categorical:
        rows = _long(
            both_sides(reference, current, categorical), categorical, lambda c: F.col(c).cast("string")
        )
        level = F.coalesce("value", F.lit(S.MISSING_LEVEL)).alias("level")
        parts.append(rows.groupBy("feature", level).agg(*_side_counts()))
    if numeric:
        edges = decile_edges(reference, numeric, bins)
        if cells is None:
            level = _numeric_level(edges).alias("level")
            numbers = _long(both_sides(reference, current, numeric), numeric, number_or_null)
            levels = numbers.filter(F.col("value").isNotNull()).groupBy("feature", level).agg(*_side_counts())
            parts.append(_with_empty_bins(levels, edges))
        else:
            parts.append(binned(cells, edges))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def feature_drift(reference: DataFrame, current: DataFrame, numeric=None, categorical=None,
                  bins=S.PSI_BINS) -> DataFrame:
    """PSI and KS per feature on raw values, largest PSI first; KS is missing for categories.

    A numeric feature without values on one side has PSI 0; ``cur_missing`` shows that case.
    """
    numeric = S.NUMERIC if numeric is None else numeric
    categorical = S.CATEGORICAL if categorical is None else categorical
    cells = _number_cells(reference, current, numeric) if numeric else None
    psi = psi_from_counts(
        level_counts(reference, current, numeric, categorical, bins, cells), by=["feature"]
    )
    is_number = F.col("feature").isin(list(numeric))
    out = _missing_rates(current, [*categorical, *numeric], numeric).join(psi, "feature", "left")
    if numeric:
        one_sided = (F.col("ref_rows") == 0) | (F.col("cur_rows") == 0)
        out = out.withColumn("psi", F.when(is_number & one_sided, 0.0).otherwise(F.col("psi")))
        ks = cells_ks(cells, _number_edges(reference, current, numeric))
        out = out.join(ks, "feature", "left").withColumn("ks", F.when(is_number, F.coalesce("ks", F.lit(0.0))))
    else:
        out = out.withColumn("ks", F.lit(None).cast("double"))
    psi_value = F.coalesce("psi", F.lit(0.0))
    return out.select(
        "feature", psi_value.alias("psi"), "ks", "cur_missing", drift_band(psi_value).alias("band")
    ).orderBy(F.col("psi").desc(), F.col("feature"))


def _missing_rates(current, columns, numeric):
    rates = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg((number_or_null(c) if c in numeric else F.col(c)).isNull().cast("double")).alias("cur_missing"),
        )
        for c in columns
    ]
    return current.agg(F.array(*rates).alias("_m")).select(F.inline("_m"))


def categorical_psi(reference: DataFrame, current: DataFrame, column) -> DataFrame:
    return feature_drift(reference, current, [], [column]).select("feature", "psi")


def numeric_psi(reference: DataFrame, current: DataFrame, column, bins=S.PSI_BINS) -> DataFrame:
    psi = psi_from_counts(level_counts(reference, current, [column], [], bins), by=["feature"])
    one_sided = (F.col("ref_rows") == 0) | (F.col("cur_rows") == 0)
    frame = small_table(reference.sparkSession, [(column,)], "feature string")
    value = F.when(one_sided | F.col("psi").isNull(), 0.0).otherwise(F.col("psi"))
    return frame.join(psi, "feature", "left").select("feature", value.alias("psi"))


def ks_statistic(reference: DataFrame, current: DataFrame, columns, edges=None) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else list(columns)
    if edges is None:
        edges = _number_edges(reference, current, columns)
    found = cells_ks(_number_cells(reference, current, columns), edges)
    frame = small_table(reference.sparkSession, [(c,) for c in columns], "feature string")
    return frame.join(found, "feature", "left").select("feature", F.coalesce("ks", F.lit(0.0)).alias("ks"))


def prediction_drift(reference: DataFrame, current: DataFrame, score="churn_probability") -> DataFrame:
    """PSI of the scores and the mean score of each side; NULL and NaN are no scores."""
    value = number_or_null(score)
    means = both_sides(reference, current, [score]).agg(
        F.avg(F.when(F.col("side") == "ref", value)).alias("ref_mean_score"),
        F.avg(F.when(F.col("side") == "cur", value)).alias("cur_mean_score"),
    )
    psi = numeric_psi(reference, current, score)
    # one row on each side
    return means.withColumn("feature", F.lit(score)).join(F.broadcast(psi), "feature").select(
        F.col("psi").alias("score_psi"), "ref_mean_score", "cur_mean_score", drift_band(F.col("psi")).alias("band")
    )


def drift_report(reference: DataFrame, current: DataFrame, score=None) -> dict[str, DataFrame]:
    """Contract checks on both sides, then row counts, quality of the current side and drift tables."""
    from ebbtide.operators.contracts import check_contract, quality_counts

    check_contract(reference, require_label=False)
    check_contract(current, require_label=False)
    counts = both_sides(reference, current, [S.ID]).groupBy("side").agg(F.count("*").alias("rows"))
    report = {
        "row_counts": counts,
        "quality": quality_counts(current),
        "feature_drift": feature_drift(reference, current),
    }
    if score is not None:
        report["prediction_drift"] = prediction_drift(score(reference), score(current))
    return report
