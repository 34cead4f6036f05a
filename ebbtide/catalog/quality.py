"""Queries for sources, contracts, profiling and preparation."""

from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.catalog import fixtures as X
from ebbtide.catalog.registry import query, r6, rounded
from ebbtide.functions.columns import risk_tier
from ebbtide.operators import campaign, contracts, prep, profiling, splits
from ebbtide.operators.scoring import scored_records
from ebbtide.session import materialized, scratch_path, small_table
from ebbtide.sources import derived, tables

T_STAR, T_MID = 0.12, 0.06  # cut points of the tier queries on ``p_a``

# --- sources and sinks ------------------------------------------------------------------------------------


@query(
    "s1_read_customer_csv",
    f"WITH {X.DIRTY_SQL} {X.customer_columns_sql(identifier='CAST(customer_id AS VARCHAR)')}",
)
def s1_read_customer_csv(spark, folder):
    path = scratch_path(spark, "customers") + ".csv"
    X.dirty(spark, folder, text_id=True).write.option("header", True).csv(path)
    return rounded(tables.read_customers(spark, path))


def _tiered(spark, folder):
    scored = X.scores(spark, folder)
    return scored.select(
        F.col(S.ID).cast("string").alias(S.ID),
        F.col("p_a").alias("churn_probability"),
        risk_tier(F.col("p_a"), T_STAR, T_MID).alias("risk_tier"),
    )


_TIER_SQL = f"CASE WHEN p_a >= {T_STAR} THEN 'high' WHEN p_a >= {T_MID} THEN 'medium' ELSE 'low' END"
_SCORED_SQL = (
    f"WITH {X.SCORES_SQL} SELECT CAST(customer_id AS VARCHAR) AS customer_id, {r6('p_a', 'churn_probability')}, "
    f"{_TIER_SQL} AS risk_tier, CAST(NULL AS VARCHAR) AS top_reason_codes FROM sc"
)


@query("s2_scored_table_roundtrip", _SCORED_SQL)
def s2_scored_table_roundtrip(spark, folder):
    path = scratch_path(spark, "scored")
    tables.write_scored(_tiered(spark, folder), path)
    return rounded(tables.read_scored(spark, path))


@query("s5_table_fingerprint")
def s5_table_fingerprint(spark, folder):
    return tables.table_fingerprint(X.dirty(spark, folder))


@query("s7_scored_records", _SCORED_SQL)
def s7_scored_records(spark, folder):
    return rounded(scored_records(_tiered(spark, folder)))


@query("s9_smoke_sample")
def s9_smoke_sample(spark, folder):
    return rounded(splits.smoke_sample(X.clean(spark, folder)))


# --- contracts --------------------------------------------------------------------------------------------


_CONTRACT_COLUMNS = [S.ID, *S.RAW_FEATURES, S.LABEL]


@query(
    "v1_column_contract",
    f"WITH {X.DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRUE AS present, count(*) AS n_rows, count(*) - count({c}) AS missing FROM cust"
        for c in _CONTRACT_COLUMNS
    ),
)
def v1_column_contract(spark, folder):
    return contracts.column_contract(X.dirty(spark, folder)).drop("type")


@query(
    "v2_repeated_keys",
    "SELECT o_custkey, count(*) AS copies FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def v2_repeated_keys(spark, folder):
    return contracts.repeated_keys(derived.table(spark, folder, "orders"), "o_custkey")


@query(
    "v3_foreign_labels",
    "SELECT DISTINCT l_linenumber FROM lineitem WHERE l_linenumber IS NOT NULL AND l_linenumber NOT IN (0, 1)",
)
def v3_foreign_labels(spark, folder):
    return contracts.foreign_labels(derived.table(spark, folder, "lineitem"), "l_linenumber")


@query("v4_modelling_columns", f"WITH {X.DIRTY_SQL} {X.customer_columns_sql()}")
def v4_modelling_columns(spark, folder):
    return rounded(contracts.modelling_columns(X.dirty(spark, folder)))


def _rule_sql():
    rules = []
    for c in S.RAW_FEATURES:
        if c not in S.NULLABLE_FEATURES:
            rules.append(f"CASE WHEN {c} IS NULL THEN '{c} is missing' END")
        if c in S.NUMERIC:
            rules.append(f"CASE WHEN {c} < 0 THEN '{c} is negative' END")
    return f"concat_ws('; ', {', '.join(rules)})"


@query(
    "v5_row_violations",
    f"WITH {X.DIRTY_SQL} SELECT customer_id, {_rule_sql()} AS violations FROM cust",
)
def v5_row_violations(spark, folder):
    checked = contracts.with_violations(X.dirty(spark, folder))
    return checked.select(S.ID, F.array_join("violations", "; ").alias("violations"))


def _quality_sql(source="cust"):
    parts = []
    for c in S.RAW_FEATURES:
        low, high = S.VALID_RANGES.get(c, (None, None))
        tests = [f"{c} < {low}"] if low is not None else []
        tests += [f"{c} > {high}"] if high is not None else []
        invalid = f"count(*) FILTER (WHERE {' OR '.join(tests)})" if tests else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
            f"{invalid} AS invalid_range FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("v6_quality_counts", f"WITH {X.DIRTY_SQL} {_quality_sql()}")
def v6_quality_counts(spark, folder):
    return contracts.quality_counts(X.dirty(spark, folder))


# --- profiling --------------------------------------------------------------------------------------------


@query(
    "a1_shape",
    f"WITH {X.DIRTY_SQL} SELECT count(*) AS row_count, CAST(12 AS INTEGER) AS column_count, "
    f"{r6('avg(churned)', 'target_rate')} FROM cust",
)
def a1_shape(spark, folder):
    return rounded(profiling.shape(X.dirty(spark, folder)))


_ALL = [S.ID, *X.FEATURES, S.LABEL]


@query(
    "a3_missing_counts",
    f"WITH {X.DIRTY_SQL}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM cust" for c in _ALL
    )
    + ') SELECT "column", missing FROM m WHERE missing > 0',
)
def a3_missing_counts(spark, folder):
    return profiling.missing_counts(X.dirty(spark, folder))


@query(
    "a4_describe_numeric",
    f"WITH {X.DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, "
        f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS q50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS q75, "
        f"round(CAST(max({c}) AS DOUBLE), 2) AS max FROM cust"
        for c in [*S.NUMERIC, S.LABEL]
    ),
)
def a4_describe_numeric(spark, folder):
    return profiling.describe_numeric(X.dirty(spark, folder).persist())


@query(
    "a5_segment_rates",
    f"WITH {X.DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS segment, {c} AS level, count(*) AS customers, "
        f"round(avg(CAST(churned AS DOUBLE)), 3) AS target_rate FROM cust WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in S.CATEGORICAL
    ),
)
def a5_segment_rates(spark, folder):
    return profiling.segment_rates(X.dirty(spark, folder))


@query(
    "a5_segment_recency_after_repair",
    f"WITH {X.PREPARED_SQL} SELECT subscription_plan, region, count(*) AS customers, "
    f"{r6('avg(CAST(churned AS DOUBLE))', 'target_rate')}, {r6('avg(days_since_last_login)', 'mean_recency')}, "
    f"{r6('avg(recency_ratio)', 'mean_recency_ratio')} FROM feat GROUP BY subscription_plan, region",
)
def a5_segment_recency_after_repair(spark, folder):
    return rounded(
        X.prepared(spark, folder)
        .groupBy("subscription_plan", "region")
        .agg(
            F.count("*").alias("customers"),
            F.avg(F.col(S.LABEL).cast("double")).alias("target_rate"),
            F.avg("days_since_last_login").alias("mean_recency"),
            F.avg("recency_ratio").alias("mean_recency_ratio"),
        )
    )


@query(
    "a6_class_balance",
    f"WITH {X.DIRTY_SQL} SELECT churned, count(*) AS customers FROM cust GROUP BY churned",
)
def a6_class_balance(spark, folder):
    return profiling.class_balance(X.dirty(spark, folder))


_BOX = ["days_since_last_login", "monthly_spend", "support_tickets_raised"]


@query(
    "a7_box_statistics",
    f"""WITH {X.DIRTY_SQL}, cap AS (SELECT quantile_cont(monthly_spend, 0.95) AS cap FROM cust),
long AS ({" UNION ALL ".join(
    f"SELECT churned, '{c}' AS \"column\", "
    + (f"CASE WHEN {c} IS NOT NULL THEN least({c}, cap) END" if c == "monthly_spend" else f"CAST({c} AS DOUBLE)")
    + " AS value FROM cust CROSS JOIN cap" for c in _BOX)}),
q AS (SELECT churned, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
        quantile_cont(value, 0.75) AS q3 FROM long GROUP BY churned, "column")
SELECT q.churned, q."column", {r6('any_value(q1)', 'q1')}, {r6('any_value(median)', 'median')},
  {r6('any_value(q3)', 'q3')},
  {r6('min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))', 'whisker_low')},
  {r6('max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))', 'whisker_high')}
FROM q JOIN long ON q.churned = long.churned AND q."column" = long."column"
WHERE value IS NOT NULL GROUP BY q.churned, q."column\"""",
)
def a7_box_statistics(spark, folder):
    return rounded(profiling.box_statistics(X.dirty(spark, folder).persist()))


@query(
    "a8_tier_counts",
    f"WITH {X.SCORES_SQL} SELECT {_TIER_SQL} AS risk_tier, count(*) AS customers FROM sc GROUP BY 1",
)
def a8_tier_counts(spark, folder):
    return campaign.tier_counts(_tiered(spark, folder))


@query(
    "a9_rows_with_missing",
    f"WITH {X.DIRTY_SQL} SELECT count(*) FILTER (WHERE "
    + " OR ".join(f"{c} IS NULL" for c in _ALL)
    + ") AS rows_with_missing FROM cust",
)
def a9_rows_with_missing(spark, folder):
    return profiling.rows_with_missing(X.dirty(spark, folder))


@query(
    "a10_duplicate_rows",
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) "
    "AS BIGINT) AS duplicate_rows FROM orders",
)
def a10_duplicate_rows(spark, folder):
    return profiling.duplicate_rows(derived.table(spark, folder, "orders").select("o_custkey", "o_orderpriority"))


@query(
    "a11_outlier_profile",
    f"WITH {X.DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'max({c})', 'max')}, "
        f"count(*) FILTER (WHERE {c} > 50000.0) AS above_limit, {r6(f'quantile_cont({c}, 0.5)', 'median')}, "
        f"{r6(f'quantile_cont({c}, 0.99)', 'p99')} FROM cust"
        for c in S.CLIPPED
    ),
)
def a11_outlier_profile(spark, folder):
    return rounded(profiling.outlier_profile(X.dirty(spark, folder).persist(), limit=50000.0))


@query(
    "a12_impossible_rows",
    f"WITH {X.DIRTY_SQL} SELECT count(*) FILTER (WHERE account_age_days < 0 OR account_age_days > 3650 "
    "OR monthly_spend < 0 OR num_orders_last_90d < 0 OR avg_order_value < 0 OR support_tickets_raised < 0 "
    "OR days_since_last_login < 0 OR days_since_last_login > 365 OR pages_per_session < 0) AS impossible_rows "
    "FROM cust",
)
def a12_impossible_rows(spark, folder):
    return profiling.impossible_rows(X.dirty(spark, folder))


@query(
    "a13_spend_without_orders",
    f"WITH {X.DIRTY_SQL} SELECT count(*) FILTER (WHERE num_orders_last_90d = 0 AND monthly_spend > 0) "
    "AS spend_without_orders FROM cust",
)
def a13_spend_without_orders(spark, folder):
    return profiling.spend_without_orders(X.dirty(spark, folder))


@query(
    "a14_label_correlation",
    f"WITH {X.PREPARED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'corr({c}, churned)', 'correlation')} FROM feat"
        for c in S.MODEL_NUMERIC
    ),
)
def a14_label_correlation(spark, folder):
    return rounded(profiling.label_correlation(X.prepared(spark, folder), S.MODEL_NUMERIC))


@query(
    "a15_class_medians",
    f"WITH {X.PREPARED_SQL} "
    + " UNION ALL ".join(
        f"SELECT churned, '{c}' AS \"column\", {r6(f'quantile_cont({c}, 0.5)', 'median')} FROM feat "
        "GROUP BY churned"
        for c in S.MODEL_NUMERIC
    ),
)
def a15_class_medians(spark, folder):
    return rounded(profiling.class_medians(materialized(X.prepared(spark, folder), "prepared"), S.MODEL_NUMERIC))


_ARM = "CASE WHEN customer_id % 2 = 0 THEN 'treated' ELSE 'control' END"


@query(
    "a17_retention_lift",
    f"""WITH {X.SCORES_SQL}, h AS (SELECT {_ARM} AS arm, 1.0 - churned AS kept FROM sc WHERE p_a >= {T_STAR}),
g AS (SELECT count(*) FILTER (WHERE arm = 'treated') AS nt, count(*) FILTER (WHERE arm = 'control') AS nc,
  avg(CAST(kept AS DOUBLE)) FILTER (WHERE arm = 'treated') AS pt,
  avg(CAST(kept AS DOUBLE)) FILTER (WHERE arm = 'control') AS pc FROM h),
e AS (SELECT *, sqrt(pt * (1 - pt) / nt + pc * (1 - pc) / nc) AS se FROM g)
SELECT nt AS treated, nc AS control, {r6('pt', 'treated_retention')}, {r6('pc', 'control_retention')},
  {r6('pt - pc', 'lift')}, {r6('pt - pc - 1.96 * se', 'lift_low')}, {r6('pt - pc + 1.96 * se', 'lift_high')} FROM e""",
)
def a17_retention_lift(spark, folder):
    high = X.scores(spark, folder).filter(F.col("p_a") >= T_STAR)
    arms = high.withColumn("arm", F.when(F.col(S.ID) % 2 == 0, "treated").otherwise("control"))
    return rounded(profiling.retention_lift(arms, "arm"))


# --- preparation ------------------------------------------------------------------------------------------


def _rounded_list(columns):
    return ", ".join(r6(c, c) for c in columns)


@query("p1_range_repair", f"WITH {X.PREPARED_SQL} SELECT customer_id, {_rounded_list(S.NUMERIC)} FROM rep")
def p1_range_repair(spark, folder):
    return rounded(prep.repair_ranges(X.dirty(spark, folder)).select(S.ID, *S.NUMERIC))


@query(
    "p2_clip_bounds",
    f"WITH {X.FITTED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'{c}_lo', 'low')}, {r6(f'{c}_hi', 'high')} FROM bounds" for c in S.CLIPPED
    ),
)
def p2_clip_bounds(spark, folder):
    train = X.prepared(spark, folder).filter(X.TRAIN).persist()
    rows = [(c, *b) for c, b in prep.clip_bounds(train, S.CLIPPED).items()]
    return rounded(small_table(spark, rows, "column string, low double, high double"))


@query(
    "p3_clip_to_bounds",
    f"WITH {X.FITTED_SQL} SELECT customer_id, {_rounded_list(S.CLIPPED)} FROM clip WHERE customer_id % 3 = 0",
)
def p3_clip_to_bounds(spark, folder):
    rows = X.prepared(spark, folder).persist()
    model = prep.QuantileClip(columns=S.CLIPPED).fit(rows.filter(X.TRAIN))
    return rounded(model.transform(rows.filter(X.APPLY)).select(S.ID, *S.CLIPPED))


@query(
    "p4_p5_p6_derived_features",
    f"WITH {X.PREPARED_SQL} SELECT customer_id, {_rounded_list(S.DERIVED)} FROM feat",
)
def p4_p5_p6_derived_features(spark, folder):
    return rounded(X.prepared(spark, folder).select(S.ID, *S.DERIVED))


def _statistics(spark, folder):
    rows = X.prepared(spark, folder).persist()
    return rows, prep.learn_statistics(rows.filter(X.TRAIN))[None]


@query(
    "p7_medians",
    f"WITH {X.FITTED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'{c}_m', 'median')} FROM med" for c in S.MODEL_NUMERIC
    ),
)
def p7_medians(spark, folder):
    _, stats = _statistics(spark, folder)
    rows = [(n.name, n.median) for n in stats.numbers]
    return rounded(small_table(spark, rows, "column string, median double"))


def _indicator_sql():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", customer_id, {c}_na AS missing FROM filled WHERE customer_id % 3 = 0 "
        f"AND (SELECT max({c}_na) FROM filled WHERE customer_id % 3 <> 0) = 1"
        for c in S.MODEL_NUMERIC
    )


@query("p8_missing_indicators", f"WITH {X.FITTED_SQL} {_indicator_sql()}")
def p8_missing_indicators(spark, folder):
    rows, stats = _statistics(spark, folder)
    kept = [n for n in stats.numbers if n.had_missing]
    wide = prep.prepared_expressions(stats)
    # undo the scaling of the prepared indicator, which gives 0 or 1 back
    entries = [
        F.struct(
            F.lit(n.name).alias("column"),
            F.round(wide[prep.INDICATOR + n.name] * n.missing_scale + n.missing_mean).cast("int").alias("missing"),
        )
        for n in kept
    ]
    return rows.filter(X.APPLY).select(S.ID, F.inline(F.array(*entries)))


@query(
    "p9_standardized",
    f"WITH {X.FITTED_SQL} SELECT customer_id, {_rounded_list(S.MODEL_NUMERIC)} FROM std WHERE customer_id % 3 = 0",
)
def p9_standardized(spark, folder):
    rows, stats = _statistics(spark, folder)
    wide = prep.prepared_expressions(stats)
    return rounded(
        rows.filter(X.APPLY).select(S.ID, *[wide[n.name].alias(n.name) for n in stats.usable_numbers])
    )


@query(
    "p10_most_frequent_levels",
    f"WITH {X.PREPARED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT {c} FROM feat WHERE customer_id % 3 <> 0 AND {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS fill"
        for c in S.CATEGORICAL
    ),
)
def p10_most_frequent_levels(spark, folder):
    train = X.prepared(spark, folder).filter(X.TRAIN)
    stats = prep.learn_statistics(train, numeric=[])[None]
    return small_table(spark, [(v.name, v.fill) for v in stats.levels], "column string, fill string")


def _onehot_sql():
    parts = []
    for c in S.CATEGORICAL:
        fill = (
            f"(SELECT {c} FROM feat WHERE customer_id % 3 <> 0 AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)"
        )
        parts.append(
            f"SELECT a.customer_id, concat('{c}', '_', l.level) AS feature, "
            f"CAST(CASE WHEN coalesce(a.{c}, {fill}) = l.level THEN 1 ELSE 0 END AS DOUBLE) AS value "
            f"FROM feat a CROSS JOIN (SELECT DISTINCT {c} AS level FROM feat WHERE customer_id % 3 <> 0 "
            f"AND {c} IS NOT NULL) l WHERE a.customer_id % 3 = 0"
        )
    return " UNION ALL ".join(parts)


@query("p11_one_hot", f"WITH {X.PREPARED_SQL} {_onehot_sql()}")
def p11_one_hot(spark, folder):
    rows = X.prepared(spark, folder).persist()
    stats = prep.learn_statistics(rows.filter(X.TRAIN), numeric=[])[None]
    wide = prep.prepared_expressions(stats)
    entries = [F.struct(F.lit(n).alias("feature"), e.alias("value")) for n, e in wide.items()]
    return rows.filter(X.APPLY).select(S.ID, F.inline(F.array(*entries)))


@query("p12_feature_vector")
def p12_feature_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array

    rows = X.prepared(spark, folder).persist()
    model = prep.FeaturePrep().fit(rows.filter(X.TRAIN))
    return model.transform(rows.filter(X.APPLY)).select(
        S.ID, F.col(S.LABEL), vector_to_array("features").alias("features")
    )


@query("p13_feature_names")
def p13_feature_names(spark, folder):
    _, stats = _statistics(spark, folder)
    return small_table(spark, list(enumerate(stats.feature_names())), "position int, feature string")


@query(
    "p14_risk_tiers",
    f"WITH {X.SCORES_SQL} SELECT customer_id, {r6('p_a', 'p_a')}, {_TIER_SQL} AS risk_tier FROM sc",
)
def p14_risk_tiers(spark, folder):
    scored = X.scores(spark, folder)
    return rounded(scored.select(S.ID, "p_a", risk_tier(F.col("p_a"), T_STAR, T_MID).alias("risk_tier")))


@query(
    "p15_contact_priority",
    f"WITH {X.SCORES_SQL} SELECT s.customer_id, {r6('s.p_a * c.monthly_spend', 'priority')} FROM sc s "
    "JOIN cust c ON s.customer_id = c.customer_id "
    "ORDER BY s.p_a * c.monthly_spend DESC NULLS LAST, s.customer_id LIMIT 100",
)
def p15_contact_priority(spark, folder):
    customers = X.clean(spark, folder)
    r = F.coalesce("days_since_last_login", F.lit(0)).cast("double")
    a = F.coalesce("account_age_days", F.lit(0)).cast("double")
    scored = customers.select(
        S.ID, "monthly_spend", (r / (r + a + 1.0)).alias("p_a")
    )
    return rounded(campaign.contact_list(scored, "p_a", "monthly_spend", 100).select(S.ID, "priority"))
