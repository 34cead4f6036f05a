"""Queries for drift between two tables and linear explanations."""

from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.catalog import fixtures as X
from ebbtide.catalog.quality import _quality_sql
from ebbtide.catalog.registry import query, r6, rounded
from ebbtide.functions import columns as C
from ebbtide.operators import drift, explain, prep
from ebbtide.plans import drift_job
from ebbtide.session import scratch_path
from ebbtide.sources import derived

EVEN, ODD = "customer_id % 2 = 0", "customer_id % 2 = 1"
EPS = "CAST(0.000001 AS DOUBLE)"

EVENTS_SQL = """
ev AS (SELECT event_type, CAST(value AS DOUBLE) AS value,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'ref' ELSE 'cur' END AS side FROM events)"""
ORDERS_SQL = """
od AS (SELECT CASE WHEN year(o_orderdate) <= 1997 THEN o_totalprice ELSE o_totalprice * 1.2 END AS value,
         CASE WHEN year(o_orderdate) <= 1997 THEN 'ref' ELSE 'cur' END AS side FROM orders)"""
LABELS_SQL = """
lb AS (SELECT CAST(quality AS DOUBLE) AS value,
         CASE WHEN doc_id % 2 = 0 THEN 'ref' ELSE 'cur' END AS side FROM labels)"""


def _psi_sql(levels):
    """PSI from a (level, r, c) source, in the plain form."""
    return f"""(SELECT sum(((c + {EPS}) / (ct + {EPS}) - (r + {EPS}) / (rt + {EPS}))
      * ln(((c + {EPS}) / (ct + {EPS})) / ((r + {EPS}) / (rt + {EPS}))))
    FROM (SELECT r, c, sum(r) OVER () AS rt, sum(c) OVER () AS ct FROM ({levels})))"""


def _categorical_levels(source, column):
    return (
        f"SELECT coalesce(CAST({column} AS VARCHAR), '__MISSING__') AS level, "
        f"count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c "
        f"FROM {source} GROUP BY 1"
    )


def _numeric_levels(source, column):
    """All bins between the distinct reference deciles, empty ones too."""
    edges = (
        f"(SELECT list_sort(list_distinct(quantile_cont(CAST({column} AS DOUBLE), "
        f"[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) FROM {source} WHERE side = 'ref')"
    )
    place = f"CAST(len(list_filter(e[2:len(e) - 1], lambda x: x <= {column})) AS BIGINT)"
    return f"""SELECT b.bin AS level, count(v.bin) FILTER (WHERE v.side = 'ref') AS r,
      count(v.bin) FILTER (WHERE v.side = 'cur') AS c
    FROM (SELECT unnest(range(len({edges}) - 1)) AS bin) b
    LEFT JOIN (SELECT side, {place} AS bin FROM {source}, (SELECT {edges} AS e) WHERE {column} IS NOT NULL) v
      ON b.bin = v.bin GROUP BY b.bin"""


def _ks_sql(source, column):
    return f"""(SELECT max(abs(ru / rt - cu / ct)) FROM (
      SELECT CAST(sum(r) OVER (ORDER BY v) AS DOUBLE) AS ru, CAST(sum(c) OVER (ORDER BY v) AS DOUBLE) AS cu,
        CAST(sum(r) OVER () AS DOUBLE) AS rt, CAST(sum(c) OVER () AS DOUBLE) AS ct FROM (
        SELECT {column} AS v, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c
        FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)))"""


@query(
    "d1_psi_from_counts",
    f"WITH {EVENTS_SQL} SELECT count(*) FILTER (WHERE side = 'ref') AS ref_rows, "
    f"count(*) FILTER (WHERE side = 'cur') AS cur_rows, "
    f"{r6(_psi_sql(_categorical_levels('ev', 'event_type')), 'psi')} FROM ev",
)
def d1_psi_from_counts(spark, folder):
    first, second = derived.halves_of_events(spark, folder)
    counts = drift.level_counts(first, second, categorical=["event_type"])
    return rounded(drift.psi_from_counts(counts))


@query(
    "d2_categorical_psi",
    f"WITH {X.DIRTY_SQL}, s AS (SELECT *, CASE WHEN {EVEN} THEN 'ref' ELSE 'cur' END AS side FROM cust) "
    f"SELECT 'device_type' AS feature, {r6(_psi_sql(_categorical_levels('s', 'device_type')), 'psi')}",
)
def d2_categorical_psi(spark, folder):
    rows = X.dirty(spark, folder).persist()
    return rounded(drift.categorical_psi(rows.filter(EVEN), rows.filter(ODD), "device_type"))


@query(
    "d3_numeric_psi",
    f"WITH {EVENTS_SQL} SELECT 'value' AS feature, {r6(_psi_sql(_numeric_levels('ev', 'value')), 'psi')}",
)
def d3_numeric_psi(spark, folder):
    first, second = derived.halves_of_events(spark, folder)
    return rounded(drift.numeric_psi(first, second, "value"))


def _shifted_orders(spark, folder):
    orders = derived.table(spark, folder, "orders")
    old = F.year("o_orderdate") <= 1997
    return (
        orders.filter(old).select(F.col("o_totalprice").alias("value")),
        orders.filter(~old).select((F.col("o_totalprice") * 1.2).alias("value")),
    )


@query(
    "d3_d4_d7_shifted_orders",
    f"""WITH {ORDERS_SQL}, m AS (SELECT {_psi_sql(_numeric_levels('od', 'value'))} AS psi,
  {_ks_sql('od', 'value')} AS ks)
SELECT 'value' AS feature, {r6('psi', 'psi')}, {r6('ks', 'ks')}, CAST(0 AS DOUBLE) AS cur_missing,
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.2 THEN 'watch' ELSE 'investigate' END AS band FROM m""",
)
def d3_d4_d7_shifted_orders(spark, folder):
    old, new = _shifted_orders(spark, folder)
    return rounded(drift.feature_drift(old, new, ["value"], []))


@query(
    "d3_few_distinct_values",
    f"WITH {LABELS_SQL} SELECT 'quality' AS feature, {r6(_psi_sql(_categorical_levels('lb', 'value')), 'psi')}",
)
def d3_few_distinct_values(spark, folder):
    """Too few edges for bins: values are compared as levels."""
    labels = derived.table(spark, folder, "labels")
    return rounded(
        drift.numeric_psi(labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 <> 0"), "quality")
    )


@query("d4_ks_statistic", f"WITH {EVENTS_SQL} SELECT 'value' AS feature, {r6(_ks_sql('ev', 'value'), 'ks')}")
def d4_ks_statistic(spark, folder):
    first, second = derived.halves_of_events(spark, folder)
    return rounded(drift.ks_statistic(first, second, "value"))


@query(
    "d4_ks_line_prices",
    f"""WITH lp AS (SELECT l_extendedprice AS value,
  CASE WHEN l_linestatus = 'O' THEN 'cur' ELSE 'ref' END AS side FROM lineitem)
SELECT 'l_extendedprice' AS feature, {r6(_ks_sql('lp', 'value'), 'ks')}""",
)
def d4_ks_line_prices(spark, folder):
    """KS of a nearly distinct column of the largest table, split at value edges."""
    from ebbtide.operators.ordering import value_edges

    lines = derived.table(spark, folder, "lineitem").select("l_extendedprice", "l_linestatus")
    edges = value_edges(lines, "l_extendedprice")
    is_new = F.col("l_linestatus") == "O"
    return rounded(drift.ks_statistic(lines.filter(~is_new), lines.filter(is_new), "l_extendedprice", edges))


def _drift_sql():
    parts = []
    for c in S.CATEGORICAL:
        parts.append(
            f"SELECT '{c}' AS feature, {_psi_sql(_categorical_levels('s', c))} AS psi, "
            f"CAST(NULL AS DOUBLE) AS ks, (SELECT avg(CAST({c} IS NULL AS INTEGER)) FROM s WHERE side = 'cur') AS miss"
        )
    for c in S.NUMERIC:
        parts.append(
            f"SELECT '{c}' AS feature, {_psi_sql(_numeric_levels('s', c))} AS psi, {_ks_sql('s', c)} AS ks, "
            f"(SELECT avg(CAST({c} IS NULL AS INTEGER)) FROM s WHERE side = 'cur') AS miss"
        )
    return f"""WITH {X.DIRTY_SQL}, s AS (SELECT *, CASE WHEN {EVEN} THEN 'ref' ELSE 'cur' END AS side FROM cust),
d AS ({" UNION ALL ".join(parts)})
SELECT feature, {r6('psi', 'psi')}, {r6('ks', 'ks')}, {r6('miss', 'cur_missing')},
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.2 THEN 'watch' ELSE 'investigate' END AS band FROM d"""


@query("d5_d7_feature_drift", _drift_sql())
def d5_d7_feature_drift(spark, folder):
    rows = X.dirty(spark, folder).persist()
    return rounded(drift.feature_drift(rows.filter(EVEN), rows.filter(ODD)))


@query("d5_s8_drift_against_stored_profile", _drift_sql())
def d5_s8_drift_against_stored_profile(spark, folder):
    """The reference is stored as the profiles of two days; its rows are not read for the report."""
    rows = X.dirty(spark, folder, text_id=True).persist()
    number = F.col(S.ID).cast("long")
    stored = scratch_path(spark, "drift-baseline")
    drift_job.save_baseline(rows.filter(number % 4 == 0), stored)
    drift_job.save_baseline(rows.filter(number % 4 == 2), stored, mode="append")
    paths = drift_job.write_baseline_report(stored, rows.filter(number % 2 == 1), scratch_path(spark, "drift"))
    return rounded(spark.read.parquet(paths["feature_drift"]))


@query(
    "d5_identical_tables",
    f"WITH {X.DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(0 AS DOUBLE) AS psi, "
        + ("CAST(0 AS DOUBLE)" if c in S.NUMERIC else "CAST(NULL AS DOUBLE)")
        + f" AS ks, {r6(f'avg(CAST({c} IS NULL AS INTEGER))', 'cur_missing')}, 'stable' AS band FROM cust"
        for c in S.RAW_FEATURES
    ),
)
def d5_identical_tables(spark, folder):
    rows = X.dirty(spark, folder).persist()
    return rounded(drift.feature_drift(rows, rows))


@query(
    "d6_prediction_drift",
    f"""WITH {X.SCORES_SQL}, s AS (SELECT *, CASE WHEN {EVEN} THEN 'ref' ELSE 'cur' END AS side FROM sc),
m AS (SELECT {_psi_sql(_numeric_levels('s', 'p_a'))} AS psi)
SELECT {r6('psi', 'score_psi')}, {r6("(SELECT avg(p_a) FROM s WHERE side = 'ref')", 'ref_mean_score')},
  {r6("(SELECT avg(p_a) FROM s WHERE side = 'cur')", 'cur_mean_score')},
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.2 THEN 'watch' ELSE 'investigate' END AS band FROM m""",
)
def d6_prediction_drift(spark, folder):
    scored = X.scores(spark, folder).persist()
    return rounded(drift.prediction_drift(scored.filter(EVEN), scored.filter(ODD), "p_a"))


@query(
    "d6_prediction_drift_strange_scores",
    f"""WITH {X.SCORES_SQL}, s AS (SELECT *, CASE WHEN {EVEN} THEN 'ref' ELSE 'cur' END AS side FROM sc
      WHERE customer_id % 7 <> 0 AND customer_id % 5 <> 0),
m AS (SELECT {_psi_sql(_numeric_levels('s', 'p_a'))} AS psi)
SELECT {r6('psi', 'score_psi')}, {r6("(SELECT avg(p_a) FROM s WHERE side = 'ref')", 'ref_mean_score')},
  {r6("(SELECT avg(p_a) FROM s WHERE side = 'cur')", 'cur_mean_score')},
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.2 THEN 'watch' ELSE 'investigate' END AS band FROM m""",
)
def d6_prediction_drift_strange_scores(spark, folder):
    """NULL and NaN scores on both sides are no scores, neither for the means nor for the PSI."""
    number = F.col("customer_id").cast("long")
    score = F.when(number % 7 == 0, float("nan")).when(number % 5 == 0, None).otherwise(F.col("p_a"))
    scored = X.scores(spark, folder).withColumn("p_a", score)
    return rounded(drift.prediction_drift(scored.filter(EVEN), scored.filter(ODD), "p_a"))


def _report(spark, folder):
    rows = X.dirty(spark, folder, text_id=True).persist()
    number = F.col(S.ID).cast("long")
    path = scratch_path(spark, "drift")
    return drift_job.write_drift_report(rows.filter(number % 2 == 0), rows.filter(number % 2 == 1), path)


@query(
    "d8_s8_report_row_counts",
    f"WITH {X.DIRTY_SQL} SELECT CASE WHEN {EVEN} THEN 'ref' ELSE 'cur' END AS side, count(*) AS \"rows\" "
    "FROM cust GROUP BY 1",
)
def d8_s8_report_row_counts(spark, folder):
    return spark.read.parquet(_report(spark, folder)["row_counts"])


@query(
    "d8_s8_report_quality",
    f"WITH {X.DIRTY_SQL}, odd AS (SELECT * FROM cust WHERE {ODD}) {_quality_sql('odd')}",
)
def d8_s8_report_quality(spark, folder):
    return spark.read.parquet(_report(spark, folder)["quality"])


@query("d8_s8_report_feature_drift", _drift_sql())
def d8_s8_report_feature_drift(spark, folder):
    return rounded(spark.read.parquet(_report(spark, folder)["feature_drift"]))


# --- linear explanations ------------------------------------------------------------------------------------

# Fixed coefficients for the prepared numeric features, so that SQL can follow the explanation.
COEFFICIENTS = {
    "account_age_days": -0.31,
    "monthly_spend": -0.22,
    "num_orders_last_90d": -0.47,
    "avg_order_value": 0.13,
    "support_tickets_raised": 0.29,
    "days_since_last_login": 0.58,
    "pages_per_session": -0.17,
    "recency_ratio": 0.41,
    "is_dormant": 0.37,
    "support_per_order": 0.11,
}


def _standardized(spark, folder):
    rows = X.prepared(spark, folder).persist()
    stats = prep.learn_statistics(rows.filter(X.TRAIN), categorical=[])[None]
    wide = prep.prepared_expressions(stats)
    return rows.filter(X.APPLY).select(
        S.ID, S.LABEL, F.array(*[wide[c] for c in S.MODEL_NUMERIC]).alias("z")
    )


@query(
    "i2_contributions",
    f"WITH {X.FITTED_SQL} SELECT customer_id, "
    + ", ".join(r6(f"{c} * CAST({w} AS DOUBLE)", c) for c, w in COEFFICIENTS.items())
    + " FROM std WHERE customer_id % 3 = 0",
)
def i2_contributions(spark, folder):
    parts = C.contributions(F.col("z"), COEFFICIENTS.values())
    rows = _standardized(spark, folder).select(S.ID, parts.alias("c"))
    return rounded(
        rows.select(S.ID, *[F.element_at("c", i + 1).alias(n) for i, n in enumerate(COEFFICIENTS)])
    )


_GAPS_SQL = f"""{X.FITTED_SQL}, g AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE churned = 1) - avg({c}) FILTER (WHERE churned = 0) AS coef "
    "FROM std WHERE customer_id % 3 = 0" for c in S.MODEL_NUMERIC)})"""


def _class_gaps(spark, folder):
    """Difference of the class means of each standardized feature, used as coefficients."""
    rows = _standardized(spark, folder)
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            (
                F.avg(F.when(F.col(S.LABEL) == 1, F.element_at("z", i + 1)))
                - F.avg(F.when(F.col(S.LABEL) == 0, F.element_at("z", i + 1)))
            ).alias("coef"),
        )
        for i, c in enumerate(S.MODEL_NUMERIC)
    ]
    return rows.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


@query(
    "i3_odds_ratios",
    f"WITH {_GAPS_SQL} SELECT feature, {r6('coef', 'coef')}, {r6('exp(coef)', 'odds_ratio')} FROM g",
)
def i3_odds_ratios(spark, folder):
    return rounded(explain.odds_ratios(_class_gaps(spark, folder)))


@query(
    "i6_top_odds_ratios",
    f"WITH {_GAPS_SQL} SELECT feature, {r6('coef', 'coef')}, {r6('exp(coef)', 'odds_ratio')} FROM g "
    "ORDER BY abs(coef) DESC, feature LIMIT 8",
)
def i6_top_odds_ratios(spark, folder):
    return rounded(explain.odds_ratios(_class_gaps(spark, folder), top=8))


def _reason_sql():
    parts = " UNION ALL ".join(
        f"SELECT customer_id, {i} AS place, '{c}' AS name, {c} * CAST({w} AS DOUBLE) AS v FROM std "
        "WHERE customer_id % 3 = 0"
        for i, (c, w) in enumerate(COEFFICIENTS.items())
    )
    return f"""WITH {X.FITTED_SQL}, p AS ({parts}),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(v) DESC, place) AS rn FROM p)
SELECT customer_id, string_agg(name || CASE WHEN v >= 0 THEN '(+)' ELSE '(-)' END, '; ' ORDER BY rn)
  AS top_reason_codes FROM r WHERE rn <= 3 GROUP BY customer_id"""


@query("i5_reason_codes", _reason_sql())
def i5_reason_codes(spark, folder):
    parts = C.contributions(F.col("z"), COEFFICIENTS.values())
    return _standardized(spark, folder).select(
        S.ID, C.reason_codes(parts, list(COEFFICIENTS)).alias("top_reason_codes")
    )
