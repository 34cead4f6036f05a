"""Ranking metrics and curves from (score, positives, negatives) cells, exact at any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import interior_edges_below, number_or_null
from ebbtide.operators import ordering


def with_usable_score(df: DataFrame, score, label=S.LABEL, by=()) -> DataFrame:
    """``by..., score, y`` of the rows that metrics are made of: NULL and NaN scores and NULL labels are left out.

    Infinite scores are scores: they rank below or above all others.
    """
    rows = df.select(*by, number_or_null(score).alias("score"), F.col(label).alias("y"))
    return rows.filter(F.col("score").isNotNull() & F.col("y").isNotNull())


def score_cells(df: DataFrame, score, label=S.LABEL, by=()) -> DataFrame:
    """Positives and negatives per distinct score."""
    by = list(by)
    return with_usable_score(df, score, label, by).groupBy(*by, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def ranked_cells(df: DataFrame, score, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """Cells with the counts of positives and negatives scored strictly below, and at or above."""
    if edges is None:
        edges = ordering.value_edges(df, score)
    totals = ordering.running_totals(score_cells(df, score, label, by), by, "score", ["pos", "neg"], edges)
    return totals.withColumns(
        {
            "neg_below": F.col("neg_upto") - F.col("neg"),
            "tp": F.col("pos_total") - F.col("pos_upto") + F.col("pos"),
            "fp": F.col("neg_total") - F.col("neg_upto") + F.col("neg"),
        }
    )


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_metrics(tp, fp, fn):
    """Precision, recall and F1 columns; an empty denominator gives 0."""
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion_counts(df: DataFrame, score, threshold, label=S.LABEL, by=()) -> DataFrame:
    """The four confusion counts at ``score >= threshold``; all four are present even for one class."""
    hit = F.col("score") >= threshold
    return with_usable_score(df, score, label, by).groupBy(*by).agg(
        F.count_if(~hit & (F.col("y") == 0)).alias("tn"),
        F.count_if(hit & (F.col("y") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("y") == 1)).alias("fn"),
        F.count_if(hit & (F.col("y") == 1)).alias("tp"),
    )


def classification_metrics(df: DataFrame, score, threshold=0.5, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """Threshold metrics, ROC-AUC, average precision and Brier score per group, from one set of cells."""
    by = list(by)
    positives, negatives = F.first("pos_total"), F.first("neg_total")
    hit = F.col("score") >= threshold
    grouped = ranked_cells(df, score, label, by, edges).groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("_fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("_fn"),
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
            positives.cast("double") * negatives,
        ).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), positives).alias("pr_auc"),
        (
            F.sum(F.col("pos") * F.pow(F.col("score") - 1.0, 2.0) + F.col("neg") * F.pow("score", F.lit(2.0)))
            / F.sum(F.col("pos") + F.col("neg"))
        ).alias("brier"),
    )
    shares = confusion_metrics(F.col("_tp"), F.col("_fp"), F.col("_fn"))
    return grouped.select(
        *by,
        F.lit(float(threshold)).alias("threshold"),
        *[c.alias(n) for n, c in shares.items()],
        "roc_auc",
        "pr_auc",
        "brier",
    )


def roc_auc(df: DataFrame, score, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """Area under the ROC curve per group; ties count half."""
    by = list(by)
    return ranked_cells(df, score, label, by, edges).groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
            F.first("pos_total").cast("double") * F.first("neg_total"),
        ).alias("roc_auc")
    )


def average_precision(df: DataFrame, score, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """Step-wise area under the precision-recall curve per group."""
    by = list(by)
    return ranked_cells(df, score, label, by, edges).groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.first("pos_total")
        ).alias("pr_auc")
    )


def brier_score(df: DataFrame, score, label=S.LABEL, by=()) -> DataFrame:
    squared = F.pow(F.col("score") - F.col("y"), F.lit(2.0))
    return with_usable_score(df, score, label, by).groupBy(*by).agg(F.avg(squared).alias("brier"))


def roc_points(df: DataFrame, score, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """False and true positive rate at every distinct score, plus the (0, 0) start without a threshold."""
    by = list(by)
    cells = ranked_cells(df, score, label, by, edges)
    points = cells.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "neg_total").alias("fpr"),
        F.try_divide("tp", "pos_total").alias("tpr"),
    )
    start = cells.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return points.unionByName(
        start.select(
            *by,
            F.lit(None).cast("double").alias("threshold"),
            F.lit(0.0).alias("fpr"),
            F.lit(0.0).alias("tpr"),
        )
    )


def precision_recall_points(df: DataFrame, score, label=S.LABEL, by=(), edges=None) -> DataFrame:
    """Precision and recall at every distinct score, with the base rate beside them."""
    by = list(by)
    return ranked_cells(df, score, label, by, edges).select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "pos_total").alias("recall"),
        (F.col("pos_total") / (F.col("pos_total") + F.col("neg_total"))).alias("base_rate"),
    )


def reliability(df: DataFrame, score, label=S.LABEL, bins=10, by=()) -> DataFrame:
    """Mean score and share of positives in equal-width bins that are closed on the right."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]  # evenly stepped, as uniform bin edges are
    usable = with_usable_score(df, score, label, by)
    return usable.groupBy(*by, interior_edges_below(F.col("score"), edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_share")
    )
