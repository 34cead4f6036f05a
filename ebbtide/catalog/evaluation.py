"""Queries for splits, metrics, curves, campaign economics and resampling."""

from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.catalog import fixtures as X
from ebbtide.catalog.registry import query, r6, rounded
from ebbtide.operators import campaign, ranking, resample, splits
from ebbtide.session import small_table
from ebbtide.sources import derived

COST, VALUE, UPLIFT = S.SCENARIOS[S.DEFAULT_SCENARIO]
EVEN, ODD = "customer_id % 2 = 0", "customer_id % 2 = 1"
T = 0.1  # decision threshold of the metric queries on ``p_a``

# --- splits -----------------------------------------------------------------------------------------------

# Quotas by largest remainder for two classes: the total is rounded up first.
_HOLDOUT_SQL = f"""WITH {X.CLEAN_SQL},
n AS (SELECT churned, count(*) AS n FROM cust GROUP BY churned),
q AS (SELECT churned, n, ceil(sum(n) OVER () * 0.2) * n / sum(n) OVER () AS exact,
        ceil(sum(n) OVER () * 0.2) AS wanted FROM n),
f AS (SELECT churned, floor(exact) AS base, wanted - sum(floor(exact)) OVER () AS left_over,
        row_number() OVER (ORDER BY exact - floor(exact) DESC, churned) AS place FROM q),
quota AS (SELECT churned, base + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS quota FROM f),
r AS (SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY customer_id) AS rn FROM cust)
SELECT customer_id, r.churned, rn <= quota AS is_holdout FROM r JOIN quota ON r.churned = quota.churned"""


@query("r1_stratified_holdout", _HOLDOUT_SQL)
def r1_stratified_holdout(spark, folder):
    customers = X.clean(spark, folder).select(S.ID, S.LABEL).persist()
    return splits.with_holdout(customers, order=S.ID)


@query("r1_stratified_holdout_shuffled")
def r1_stratified_holdout_shuffled(spark, folder):
    customers = X.clean(spark, folder).select(S.ID, S.LABEL).persist()
    return splits.with_holdout(customers)


_HOLDOUT_SIZES_SQL = f"SELECT churned, is_holdout, count(*) AS customers FROM ({_HOLDOUT_SQL}) GROUP BY 1, 2"


@query("r1_shuffled_holdout_sizes", _HOLDOUT_SIZES_SQL)
def r1_shuffled_holdout_sizes(spark, folder):
    marked = splits.with_holdout(X.clean(spark, folder).select(S.ID, S.LABEL))
    return marked.groupBy(S.LABEL, "is_holdout").agg(F.count("*").alias("customers"))


@query("r1_tied_order_holdout_sizes", _HOLDOUT_SIZES_SQL)
def r1_tied_order_holdout_sizes(spark, folder):
    """A hold-out along a column with many equal values has the same exact shares."""
    order = F.coalesce("days_since_last_login", F.lit(-1))
    marked = splits.with_holdout(X.clean(spark, folder), order=order)
    return marked.groupBy(S.LABEL, "is_holdout").agg(F.count("*").alias("customers"))


def _fold_sizes_sql(folds, repeats):
    """Expected class counts per fold: classes are dealt to the folds one after the other."""
    return f"""WITH {X.CLEAN_SQL},
dealt AS (SELECT churned, (row_number() OVER (ORDER BY churned, customer_id) - 1) % {folds} AS fold FROM cust),
sizes AS (SELECT churned, CAST(fold AS INTEGER) AS fold, count(*) AS customers FROM dealt GROUP BY churned, fold)
SELECT CAST(r.range AS INTEGER) AS repeat, churned, fold, customers FROM sizes CROSS JOIN range({repeats}) r"""


@query("r2_repeated_fold_sizes", _fold_sizes_sql(S.FOLDS, S.REPEATS))
def r2_repeated_fold_sizes(spark, folder):
    customers = X.clean(spark, folder).select(S.ID, S.LABEL).persist()
    folded = splits.with_repeated_folds(customers)
    entries = [
        F.struct(F.lit(r).alias("repeat"), F.col(f"fold_{r}").alias("fold")) for r in range(S.REPEATS)
    ]
    return (
        folded.select(S.LABEL, F.inline(F.array(*entries)))
        .groupBy("repeat", S.LABEL, "fold")
        .agg(F.count("*").alias("customers"))
    )


@query("r3_shuffled_folds")
def r3_shuffled_folds(spark, folder):
    customers = X.clean(spark, folder).select(S.ID, S.LABEL).persist()
    return splits.with_folds(customers)


@query(
    "r4_ordered_folds",
    f"""WITH {X.CLEAN_SQL},
dealt AS (SELECT churned, (row_number() OVER (ORDER BY churned, customer_id) - 1) % 5 AS fold FROM cust),
sizes AS (SELECT churned, fold, count(*) AS n FROM dealt GROUP BY churned, fold),
ends AS (SELECT churned, fold, sum(n) OVER (PARTITION BY churned ORDER BY fold) AS upto, n FROM sizes),
r AS (SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY customer_id) AS rn FROM cust)
SELECT customer_id, r.churned, CAST(fold AS INTEGER) AS fold FROM r
JOIN ends ON r.churned = ends.churned AND rn <= upto AND rn > upto - n""",
)
def r4_ordered_folds(spark, folder):
    customers = X.clean(spark, folder).select(S.ID, S.LABEL).persist()
    return splits.with_folds(customers, order=S.ID)


@query(
    "r6_permuted_column",
    f"WITH {X.CLEAN_SQL} SELECT days_since_last_login, count(*) AS customers FROM cust GROUP BY 1",
)
def r6_permuted_column(spark, folder):
    """Values of a permuted column: the same multiset as before."""
    customers = X.clean(spark, folder).persist()
    permuted = resample.permute_column(customers, "days_since_last_login")
    return permuted.groupBy("days_since_last_login").agg(F.count("*").alias("customers"))


@query(
    "r6_permutation_pairing",
    f"WITH {X.CLEAN_SQL}, n AS (SELECT count(*) AS n FROM cust) "
    "SELECT CAST(range AS INTEGER) AS repeat, n AS pairs, n AS receivers, n AS donors FROM n CROSS JOIN range(3)",
)
def r6_permutation_pairing(spark, folder):
    """In every repeat each row receives once and gives once."""
    pairs = resample.permuted_pairs(X.clean(spark, folder).select(S.ID), [S.ID], 3)
    return pairs.groupBy("repeat").agg(
        F.count("*").alias("pairs"),
        F.countDistinct(S.ID).alias("receivers"),
        F.countDistinct(f"donor_{S.ID}").alias("donors"),
    )


# --- metrics ----------------------------------------------------------------------------------------------


def _cells_sql(source, score, by=""):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
cells AS (SELECT {keys}{score} AS score, count(*) FILTER (WHERE churned = 1) AS pos,
            count(*) FILTER (WHERE churned = 0) AS neg FROM {source} GROUP BY {keys}{score}),
ranked AS (SELECT *,
    CAST(sum(neg) OVER ({part}ORDER BY score) - neg AS DOUBLE) AS neg_below,
    CAST(sum(pos) OVER ({part}ORDER BY score DESC) AS DOUBLE) AS tp,
    CAST(sum(neg) OVER ({part}ORDER BY score DESC) AS DOUBLE) AS fp,
    CAST(sum(pos) OVER ({part}) AS DOUBLE) AS p, CAST(sum(neg) OVER ({part}) AS DOUBLE) AS n FROM cells)"""


_AUC = "sum(pos * (neg_below + neg / 2.0)) / (any_value(p) * any_value(n))"
_AP = "sum(pos * (tp / (tp + fp))) / any_value(p)"
_BRIER = "sum(pos * pow(score - 1, 2) + neg * pow(score, 2)) / sum(pos + neg)"


def _threshold_metrics_sql(threshold):
    tp = f"CAST(sum(CASE WHEN score >= {threshold} THEN pos ELSE 0 END) AS DOUBLE)"
    fp = f"CAST(sum(CASE WHEN score >= {threshold} THEN neg ELSE 0 END) AS DOUBLE)"
    precision, recall = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif(any_value(p), 0), 0)"
    f1 = f"coalesce(2 * {tp} / nullif({tp} + {fp} + any_value(p), 0), 0)"
    return (
        f"{r6(precision, 'precision')}, {r6(recall, 'recall')}, {r6(f1, 'f1')}, {r6(_AUC, 'roc_auc')}, "
        f"{r6(_AP, 'pr_auc')}, {r6(_BRIER, 'brier')}"
    )


@query(
    "e1_confusion",
    f"WITH {X.SCORES_SQL} SELECT count(*) FILTER (WHERE p_a < {T} AND churned = 0) AS tn, "
    f"count(*) FILTER (WHERE p_a >= {T} AND churned = 0) AS fp, "
    f"count(*) FILTER (WHERE p_a < {T} AND churned = 1) AS fn, "
    f"count(*) FILTER (WHERE p_a >= {T} AND churned = 1) AS tp FROM sc",
)
def e1_confusion(spark, folder):
    return ranking.confusion_counts(X.scores(spark, folder), "p_a", T)


@query(
    "e2_precision_recall_f1",
    f"WITH {X.LINE_SCORES_SQL}, c AS (SELECT CAST(count(*) FILTER (WHERE score >= 0.5 AND churned = 1) AS DOUBLE) tp, "
    "CAST(count(*) FILTER (WHERE score >= 0.5 AND churned = 0) AS DOUBLE) fp, "
    "CAST(count(*) FILTER (WHERE score < 0.5 AND churned = 1) AS DOUBLE) fn FROM ls) "
    f"SELECT {r6('tp / (tp + fp)', 'precision')}, {r6('tp / (tp + fn)', 'recall')}, "
    f"{r6('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM c",
)
def e2_precision_recall_f1(spark, folder):
    counts = ranking.confusion_counts(derived.line_score_table(spark, folder), "score", 0.5)
    shares = ranking.confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return rounded(counts.select(*[c.alias(n) for n, c in shares.items()]))


@query(
    "e3_roc_auc",
    f"WITH {X.SCORES_SQL}, {_cells_sql('sc', 'p_a')} SELECT {r6(_AUC, 'roc_auc')} FROM ranked",
)
def e3_roc_auc(spark, folder):
    return rounded(ranking.roc_auc(X.scores(spark, folder).persist(), "p_a"))


@query(
    "e3_roc_auc_line_items",
    f"WITH {X.LINE_SCORES_SQL}, {_cells_sql('ls', 'score')} SELECT {r6(_AUC, 'roc_auc')} FROM ranked",
)
def e3_roc_auc_line_items(spark, folder):
    return rounded(ranking.roc_auc(derived.line_score_table(spark, folder), "score"))


@query(
    "e3_roc_auc_by_price",
    f"""WITH pr AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS churned, l_linestatus AS status,
  l_extendedprice AS price FROM lineitem), {_cells_sql('pr', 'price', 'status')}
SELECT status, {r6(_AUC, 'roc_auc')} FROM ranked GROUP BY status""",
)
def e3_roc_auc_by_price(spark, folder):
    """Grouped AUC of a nearly distinct score on the largest table, split at value edges."""
    rows = derived.table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias(S.LABEL),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"),
    )
    from ebbtide.operators.ordering import value_edges

    edges = value_edges(rows, "price")
    return rounded(ranking.roc_auc(rows, "price", by=["status"], edges=edges))


# Prices with scores that are no numbers, infinite or missing, by the order's number.
_STRANGE_SQL = """sp AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS churned,
  CASE WHEN l_orderkey % 17 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 19 = 0 THEN CAST('-inf' AS DOUBLE)
       ELSE l_extendedprice END AS price
  FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0)"""


def _strange_prices(spark, folder):
    key, price = F.col("l_orderkey"), F.col("l_extendedprice")
    strange = (
        F.when(key % 11 == 0, float("nan"))
        .when(key % 13 == 0, F.lit(None))
        .when(key % 17 == 0, float("inf"))
        .when(key % 19 == 0, float("-inf"))
        .otherwise(price)
    )
    return derived.table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias(S.LABEL), strange.alias("price")
    )


@query(
    "e1_confusion_strange_scores",
    f"WITH {_STRANGE_SQL} SELECT count(*) FILTER (WHERE price < 30000 AND churned = 0) AS tn, "
    "count(*) FILTER (WHERE price >= 30000 AND churned = 0) AS fp, "
    "count(*) FILTER (WHERE price < 30000 AND churned = 1) AS fn, "
    "count(*) FILTER (WHERE price >= 30000 AND churned = 1) AS tp FROM sp",
)
def e1_confusion_strange_scores(spark, folder):
    return ranking.confusion_counts(_strange_prices(spark, folder), "price", 30000.0)


@query(
    "e3_e4_strange_scores",
    f"WITH {_STRANGE_SQL}, {_cells_sql('sp', 'price')} SELECT {r6(_AUC, 'roc_auc')}, {r6(_AP, 'pr_auc')} FROM ranked",
)
def e3_e4_strange_scores(spark, folder):
    """AUC and average precision with missing and infinite scores, split at value edges."""
    rows = _strange_prices(spark, folder)
    areas = ranking.roc_auc(rows, "price").withColumn("k", F.lit(0))
    return rounded(areas.join(ranking.average_precision(rows, "price").withColumn("k", F.lit(0)), "k").drop("k"))


@query(
    "e3_strange_scores_in_one_piece",
    f"WITH {_STRANGE_SQL}, {_cells_sql('sp', 'price')} SELECT {r6(_AUC, 'roc_auc')} FROM ranked",
)
def e3_strange_scores_in_one_piece(spark, folder):
    """The same scores split at a single edge."""
    return rounded(ranking.roc_auc(_strange_prices(spark, folder), "price", edges=[30000.0]))


@query(
    "e4_average_precision",
    f"WITH {X.SCORES_SQL}, {_cells_sql('sc', 'p_b')} SELECT {r6(_AP, 'pr_auc')} FROM ranked",
)
def e4_average_precision(spark, folder):
    return rounded(ranking.average_precision(X.scores(spark, folder).persist(), "p_b"))


@query(
    "e5_brier_score",
    f"WITH {X.SCORES_SQL} SELECT {r6('avg(pow(p_a - churned, 2))', 'brier')} FROM sc",
)
def e5_brier_score(spark, folder):
    return rounded(ranking.brier_score(X.scores(spark, folder), "p_a"))


_LONG_SQL = f"{X.SCORES_SQL}, long AS (" + " UNION ALL ".join(
    f"SELECT customer_id, churned, '{m}' AS model, {e} AS score FROM sc"
    for m, e in {"p_a": "p_a", "p_b": "p_b", "p_mean": "(p_a + p_b) / CAST(2 AS DOUBLE)"}.items()
) + ")"


def _model_scores(spark, folder):
    wide = X.scores(spark, folder).withColumn("p_mean", (F.col("p_a") + F.col("p_b")) / 2.0)
    entries = [F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("p_a", "p_b", "p_mean")]
    return wide.select(S.ID, S.LABEL, F.inline(F.array(*entries)))


@query(
    "e18_i7_metrics_by_model",
    f"WITH {_LONG_SQL}, {_cells_sql('long', 'score', 'model')} "
    f"SELECT model, CAST({T} AS DOUBLE) AS threshold, {_threshold_metrics_sql(T)} FROM ranked GROUP BY model",
)
def e18_i7_metrics_by_model(spark, folder):
    rows = _model_scores(spark, folder).persist()
    table = ranking.classification_metrics(rows, "score", T, by=["model"])
    return rounded(table).orderBy(F.col("roc_auc").desc())


@query(
    "e15_roc_points",
    f"WITH {_LONG_SQL}, {_cells_sql('long', 'score', 'model')} "
    f"SELECT model, {r6('score', 'threshold')}, {r6('fp / n', 'fpr')}, {r6('tp / p', 'tpr')} FROM ranked "
    "UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked",
)
def e15_roc_points(spark, folder):
    return rounded(ranking.roc_points(_model_scores(spark, folder).persist(), "score", by=["model"]))


@query(
    "e16_precision_recall_points",
    f"WITH {X.SCORES_SQL}, {_cells_sql('sc', 'p_a')} "
    f"SELECT {r6('score', 'threshold')}, {r6('tp / (tp + fp)', 'precision')}, {r6('tp / p', 'recall')}, "
    f"{r6('p / (p + n)', 'base_rate')} FROM ranked",
)
def e16_precision_recall_points(spark, folder):
    return rounded(ranking.precision_recall_points(X.scores(spark, folder).persist(), "p_a"))


@query(
    "e17_reliability",
    f"WITH {X.LINE_SCORES_SQL}, b AS (SELECT score, churned, CAST("
    + " + ".join(f"(score > CAST({i} AS DOUBLE) * CAST(0.1 AS DOUBLE))::INTEGER" for i in range(1, 10))
    + f" AS INTEGER) AS bin FROM ls) SELECT bin, count(*) AS n, {r6('avg(score)', 'mean_score')}, "
    f"{r6('avg(CAST(churned AS DOUBLE))', 'positive_share')} FROM b GROUP BY bin",
)
def e17_reliability(spark, folder):
    return rounded(ranking.reliability(derived.line_score_table(spark, folder), "score"))


@query(
    "e17_reliability_strange_scores",
    f"""WITH {_STRANGE_SQL}, u AS (SELECT price, CASE WHEN price % 3 < 1 THEN NULL ELSE churned END AS churned FROM sp
      WHERE NOT isinf(price)),
    b AS (SELECT price / 110000 AS score, churned FROM u WHERE churned IS NOT NULL),
    c AS (SELECT *, CAST({" + ".join(f"(score > CAST({i} AS DOUBLE) * CAST(0.1 AS DOUBLE))::INTEGER" for i in range(1, 10))}
      AS INTEGER) AS bin FROM b)
    SELECT bin, count(*) AS n, {r6('avg(score)', 'mean_score')}, {r6('avg(CAST(churned AS DOUBLE))', 'positive_share')}
    FROM c GROUP BY bin""",
)
def e17_reliability_strange_scores(spark, folder):
    """Rows without a label or without a number as their score count in no bin."""
    rows = _strange_prices(spark, folder).filter(~F.col("price").isin(float("inf"), float("-inf")) | F.col("price").isNull())
    label = F.when(F.col("price") % 3 < 1, None).otherwise(F.col(S.LABEL))
    rows = rows.withColumn(S.LABEL, label).withColumn("score", F.col("price") / 110000)
    return rounded(ranking.reliability(rows, "score"))


# --- campaign economics -----------------------------------------------------------------------------------


def _grid_sql(source, score, name="grid", where="TRUE"):
    """Counts at every threshold by comparing each cell with each of the 101 grid values."""
    return f"""
{name}_cells AS (SELECT {score} AS score, count(*) FILTER (WHERE churned = 1) AS pos,
  count(*) FILTER (WHERE churned = 0) AS neg FROM {source} WHERE {where} GROUP BY 1),
{name} AS (SELECT CAST(r.range AS INTEGER) AS step, r.range * CAST(0.01 AS DOUBLE) AS threshold,
  CAST(coalesce(sum(pos) FILTER (WHERE score >= r.range * CAST(0.01 AS DOUBLE)), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(neg) FILTER (WHERE score >= r.range * CAST(0.01 AS DOUBLE)), 0) AS BIGINT) AS fp
  FROM range(101) r CROSS JOIN {name}_cells GROUP BY r.range)"""


def _ev(cost=COST, value=VALUE, uplift=UPLIFT, tp="tp", fp="fp"):
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"({tp} * {d(uplift)} * {d(value)} - ({tp} + {fp}) * {d(cost)})"


@query(
    "e6_e11_campaign_value",
    f"""WITH {X.SCORES_SQL}, c AS (SELECT count(*) FILTER (WHERE p_a >= {T} AND churned = 1) AS tp,
  count(*) FILTER (WHERE p_a >= {T} AND churned = 0) AS fp FROM sc) SELECT tp, fp, {r6(_ev(), 'ev')} FROM c""",
)
def e6_e11_campaign_value(spark, folder):
    return rounded(campaign.value_at(X.scores(spark, folder), "p_a", T))


def _scenario_values():
    rows = ", ".join(
        f"('{n}', CAST({c} AS DOUBLE), CAST({v} AS DOUBLE), CAST({u} AS DOUBLE))"
        for n, (c, v, u) in S.SCENARIOS.items()
    )
    return f"scen(scenario, cost, value, uplift) AS (VALUES {rows})"


@query(
    "e7_break_even",
    f"""WITH {X.SCORES_SQL}, {_scenario_values()} SELECT scenario,
  {r6('any_value(cost / (value * uplift))', 'break_even')},
  count(*) FILTER (WHERE p_a >= cost / (value * uplift)) AS customers_above FROM sc CROSS JOIN scen
GROUP BY scenario""",
)
def e7_break_even(spark, folder):
    """Break-even score per scenario and how many customers reach it."""
    rows = []
    for name, economics in S.SCENARIOS.items():
        even = campaign.break_even(*map(F.lit, economics))
        above = F.count_if(F.col("p_a") >= even)
        rows.append(F.struct(F.lit(name).alias("scenario"), even.alias("break_even"), above.alias("customers_above")))
    counted = X.scores(spark, folder).agg(F.array(*rows).alias("scenarios"))
    return rounded(counted.select(F.inline("scenarios")))


@query(
    "e8_value_curve",
    f"WITH {X.SCORES_SQL}, {_grid_sql('sc', 'p_a')} "
    f"SELECT step, {r6('threshold', 'threshold')}, tp, fp, {r6(_ev(), 'ev')} FROM grid",
)
def e8_value_curve(spark, folder):
    counts = campaign.grid_counts(X.scores(spark, folder), "p_a")
    return rounded(campaign.value_curve(counts, COST, VALUE, UPLIFT))


@query(
    "e8_value_curve_line_items",
    f"WITH {X.LINE_SCORES_SQL}, {_grid_sql('ls', 'score')} "
    f"SELECT step, {r6('threshold', 'threshold')}, tp, fp, {r6(_ev(), 'ev')} FROM grid",
)
def e8_value_curve_line_items(spark, folder):
    counts = campaign.grid_counts(derived.line_score_table(spark, folder), "score")
    return rounded(campaign.value_curve(counts, COST, VALUE, UPLIFT))


@query(
    "e9_e10_cut_points",
    f"""WITH {X.SCORES_SQL}, {_grid_sql('sc', 'p_a')},
best AS (SELECT threshold AS t_star, {_ev()} AS best_ev FROM grid ORDER BY {_ev()} DESC, step LIMIT 1)
SELECT {r6('t_star', 't_star')}, {r6('best_ev', 'best_ev')},
  {r6('coalesce((SELECT quantile_cont(p_a, 0.5) FROM sc WHERE p_a < t_star), t_star / 2)', 't_mid')},
  {r6(f'CAST({COST} AS DOUBLE) / ({VALUE} * {UPLIFT})', 'break_even')} FROM best""",
)
def e9_e10_cut_points(spark, folder):
    cuts = campaign.fit_cut_points(X.scores(spark, folder).persist(), "p_a")
    row = (cuts.t_star, cuts.best_ev, cuts.t_mid, cuts.break_even)
    return rounded(small_table(spark, [row], "t_star double, best_ev double, t_mid double, break_even double"))


def _scenario_ev(tp, fp):
    return f"({tp} * uplift * value - ({tp} + {fp}) * cost)"


@query(
    "e12_scenario_sensitivity",
    f"""WITH {X.SCORES_SQL}, {_scenario_values()}, {_grid_sql('sc', 'p_a', 'val', EVEN)},
{_grid_sql('sc', 'p_a', 'held', ODD)},
ranked_ev AS (SELECT scen.*, val.threshold, row_number() OVER (PARTITION BY scenario
    ORDER BY {_scenario_ev('tp', 'fp')} DESC, step) AS rn, step FROM val CROSS JOIN scen),
total AS (SELECT tp AS tp_all, fp AS fp_all FROM held WHERE step = 0)
SELECT scenario, cost, value, uplift, {r6('cost / (value * uplift)', 'break_even')},
  {r6('r.threshold', 't_star')},
  {r6(_scenario_ev('h.tp', 'h.fp') + ' / (tp_all + fp_all) * 1000', 'ev_target_per_1k')},
  {r6(_scenario_ev('tp_all', 'fp_all') + ' / (tp_all + fp_all) * 1000', 'ev_all_per_1k')}
FROM ranked_ev r JOIN held h ON r.step = h.step CROSS JOIN total WHERE rn = 1""",
)
def e12_scenario_sensitivity(spark, folder):
    scored = X.scores(spark, folder).persist()
    return rounded(campaign.sensitivity(scored.filter(EVEN), scored.filter(ODD), "p_a"))


# --- resampling -------------------------------------------------------------------------------------------


@query("r5_e13_auc_interval")
def r5_e13_auc_interval(spark, folder):
    return resample.auc_interval(X.scores(spark, folder).persist(), "p_a")


@query(
    "r5_bootstrap_round_sizes",
    f"WITH {X.SCORES_SQL} SELECT which, CAST(range AS INTEGER) AS round, n AS n_rows "
    "FROM (SELECT count(*) AS n FROM sc) CROSS JOIN range(200) "
    "CROSS JOIN (SELECT unnest(['p_a', 'p_b']) AS which)",
)
def r5_bootstrap_round_sizes(spark, folder):
    """Every round of a paired bootstrap draws exactly the rows of the table."""
    draws = resample.bootstrap_aucs(X.scores(spark, folder).persist(), ["p_a", "p_b"], rounds=200)
    return draws.select("which", "round", "n_rows")


@query("e14_auc_difference_interval")
def e14_auc_difference_interval(spark, folder):
    return resample.auc_difference_interval(X.scores(spark, folder).persist(), "p_a", "p_b")


# --- model selection on fold AUCs of the three plain scores -------------------------------------------------

_FOLD_AUC_SQL = f"""{_LONG_SQL},
dealt AS (SELECT churned, (row_number() OVER (ORDER BY churned, customer_id) - 1) % 5 AS fold FROM sc),
sizes AS (SELECT churned, fold, count(*) AS n FROM dealt GROUP BY churned, fold),
ends AS (SELECT churned, fold, sum(n) OVER (PARTITION BY churned ORDER BY fold) AS upto, n FROM sizes),
rn AS (SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY customer_id) AS rn FROM sc),
fold AS (SELECT customer_id, fold FROM rn JOIN ends ON rn.churned = ends.churned AND rn <= upto AND rn > upto - n),
fl AS (SELECT long.*, fold FROM long JOIN fold ON long.customer_id = fold.customer_id),
{_cells_sql('fl', 'score', 'model, fold')},
auc AS (SELECT model, fold, {_AUC} AS roc_auc FROM ranked GROUP BY model, fold),
cv AS (SELECT model, avg(roc_auc) AS cv_auc_mean, stddev_pop(roc_auc) AS cv_auc_std FROM auc GROUP BY model)"""

# Preference order of the selection queries.
PREFERENCE = ["p_b", "p_mean", "p_a"]


def _fold_aucs(spark, folder):
    wide = splits.with_folds(X.scores(spark, folder).persist(), order=S.ID)
    wide = wide.withColumn("p_mean", (F.col("p_a") + F.col("p_b")) / 2.0)
    entries = [F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("p_a", "p_b", "p_mean")]
    long = wide.select(S.LABEL, "fold", F.inline(F.array(*entries)))
    return ranking.roc_auc(long, "score", by=["model", "fold"])


@query(
    "m7_fold_summary",
    f"WITH {_FOLD_AUC_SQL} SELECT model, {r6('cv_auc_mean', 'cv_auc_mean')}, {r6('cv_auc_std', 'cv_auc_std')} FROM cv",
)
def m7_fold_summary(spark, folder):
    from ebbtide.plans.training import fold_summary

    return rounded(fold_summary(_fold_aucs(spark, folder)))


@query(
    "m8_select_model",
    f"""WITH {_FOLD_AUC_SQL} SELECT model AS winner FROM cv
WHERE (SELECT max(cv_auc_mean) FROM cv) - cv_auc_mean <= 0.01
ORDER BY CASE model {" ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(PREFERENCE))} END LIMIT 1""",
)
def m8_select_model(spark, folder):
    from ebbtide.plans.training import fold_summary, selection_order

    return selection_order(fold_summary(_fold_aucs(spark, folder)), preference=PREFERENCE)


@query(
    "m9_runner_up",
    f"WITH {_FOLD_AUC_SQL} SELECT model AS runner_up FROM cv WHERE model <> 'p_b' ORDER BY cv_auc_mean DESC LIMIT 1",
)
def m9_runner_up(spark, folder):
    from ebbtide.plans.training import fold_summary, runner_up

    return runner_up(fold_summary(_fold_aucs(spark, folder)), "p_b")
