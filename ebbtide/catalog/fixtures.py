"""The derived tables of the registered queries, as DataFrames and as check SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.catalog.registry import r6
from ebbtide.operators.prep import add_derived_features, repair_ranges
from ebbtide.sources import derived

FEATURES = S.CATEGORICAL + S.NUMERIC
TRAIN = "customer_id % 3 <> 0"
APPLY = "customer_id % 3 = 0"


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return derived.customer_table(spark, folder)


def dirty(spark: SparkSession, folder: str, text_id=False) -> DataFrame:
    return derived.customer_table(spark, folder, dirty=True, text_id=text_id)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty customers after repair and feature derivation."""
    return add_derived_features(repair_ranges(dirty(spark, folder)))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return derived.score_table(clean(spark, folder))


def _customer_sql(dirty):
    age, spend, recency = "b.age_max", "b.spend / 24.0", "b.age_min"
    if dirty:
        age = f"CASE WHEN c_custkey % 200 = 0 THEN -1 ELSE {age} END"
        recency = f"CASE WHEN c_custkey % 160 = 1 THEN 999 WHEN c_custkey % 320 = 3 THEN -5 ELSE {recency} END"
        spend = f"CASE WHEN c_custkey % 76 = 2 THEN b.spend / 24.0 * 100.0 ELSE {spend} END"
    return f"""
ord AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS odate,
         date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS age
  FROM orders),
lin AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY l_orderkey),
beh AS (
  SELECT o_custkey,
    max(age) FILTER (WHERE age > 0) AS age_max, min(age) FILTER (WHERE age > 0) AS age_min,
    sum(o_totalprice) FILTER (WHERE age BETWEEN 1 AND 720) AS spend,
    avg(o_totalprice) FILTER (WHERE age BETWEEN 1 AND 720) AS order_value,
    count(*) FILTER (WHERE age BETWEEN 1 AND 360) AS recent,
    sum(returned) FILTER (WHERE age BETWEEN 1 AND 720) AS returned,
    CAST(sum(n_lines) FILTER (WHERE age BETWEEN 1 AND 720) AS DOUBLE)
      / nullif(count(n_lines) FILTER (WHERE age BETWEEN 1 AND 720), 0) AS pages,
    count(*) FILTER (WHERE age BETWEEN -179 AND 0) AS later
  FROM ord LEFT JOIN lin ON o_orderkey = l_orderkey GROUP BY o_custkey),
dev AS (
  SELECT o_custkey, o_orderpriority FROM (
    SELECT o_custkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY odate DESC, o_orderkey DESC) AS rn
    FROM ord WHERE age > 0) WHERE rn = 1),
cust AS (
  SELECT c_custkey AS customer_id, r_name AS region, d.o_orderpriority AS device_type,
    c_mktsegment AS subscription_plan,
    CAST({age} AS INTEGER) AS account_age_days,
    CAST({spend} AS DOUBLE) AS monthly_spend,
    CAST(coalesce(b.recent, 0) AS INTEGER) AS num_orders_last_90d,
    b.order_value AS avg_order_value,
    CAST(coalesce(b.returned, 0) AS INTEGER) AS support_tickets_raised,
    CAST({recency} AS INTEGER) AS days_since_last_login,
    b.pages AS pages_per_session,
    CASE WHEN coalesce(b.later, 0) > 0 THEN 0 ELSE 1 END AS churned
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN beh b ON c_custkey = b.o_custkey LEFT JOIN dev d ON c_custkey = d.o_custkey)"""


CLEAN_SQL = _customer_sql(False)
DIRTY_SQL = _customer_sql(True)


def _range_sql(column):
    low, high = S.VALID_RANGES[column]
    tests = ([f"{column} >= {low}"] if low is not None else []) + ([f"{column} <= {high}"] if high is not None else [])
    return f"CASE WHEN {' AND '.join(tests)} THEN CAST({column} AS DOUBLE) END AS {column}"


PREPARED_SQL = f"""{DIRTY_SQL},
rep AS (
  SELECT customer_id, region, device_type, subscription_plan, churned,
    {", ".join(_range_sql(c) for c in S.NUMERIC)}
  FROM cust),
feat AS (
  SELECT *,
    days_since_last_login / (account_age_days + CAST(1 AS DOUBLE)) AS recency_ratio,
    CASE WHEN days_since_last_login > 90 THEN CAST(1 AS DOUBLE)
         WHEN days_since_last_login <= 90 THEN CAST(0 AS DOUBLE) END AS is_dormant,
    support_tickets_raised / (coalesce(num_orders_last_90d, 0) + CAST(1 AS DOUBLE)) AS support_per_order
  FROM rep)"""


def _clip_sql(column):
    if column not in S.CLIPPED:
        return column
    return (
        f"CASE WHEN {column} IS NOT NULL THEN least(greatest({column}, b.{column}_lo), b.{column}_hi) END"
    )


# Statistics are learned on ids with id % 3 <> 0 and applied to the rest.
FITTED_SQL = f"""{PREPARED_SQL},
bounds AS (
  SELECT {", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in S.CLIPPED)}
  FROM feat WHERE customer_id % 3 <> 0),
clip AS (
  SELECT customer_id, churned, region, device_type, subscription_plan,
    {", ".join(f"{_clip_sql(c)} AS {c}" for c in S.MODEL_NUMERIC)}
  FROM feat CROSS JOIN bounds b),
med AS (
  SELECT {", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in S.MODEL_NUMERIC)}
  FROM clip WHERE customer_id % 3 <> 0),
filled AS (
  SELECT customer_id, churned, region, device_type, subscription_plan,
    {", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in S.MODEL_NUMERIC)},
    {", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_na" for c in S.MODEL_NUMERIC)}
  FROM clip CROSS JOIN med),
scale AS (
  SELECT {", ".join(f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd" for c in S.MODEL_NUMERIC)}
  FROM filled WHERE customer_id % 3 <> 0),
std AS (
  SELECT customer_id, churned,
    {", ".join(f"({c} - {c}_mu) / {c}_sd AS {c}" for c in S.MODEL_NUMERIC)}
  FROM filled CROSS JOIN scale)"""

SCORES_SQL = f"""{CLEAN_SQL},
sc AS (
  SELECT customer_id, churned,
    CAST(coalesce(days_since_last_login, 0) AS DOUBLE)
      / (coalesce(days_since_last_login, 0) + coalesce(account_age_days, 0) + CAST(1 AS DOUBLE)) AS p_a,
    CAST(1 AS DOUBLE) / (num_orders_last_90d + 1) AS p_b
  FROM cust)"""

LINE_SCORES_SQL = """
ls AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS churned,
         CAST(l_quantity + l_linenumber AS DOUBLE) / CAST(57 AS DOUBLE) AS score
  FROM lineitem)"""


def customer_columns_sql(source="cust", identifier="customer_id"):
    """All customer columns with doubles rounded."""
    doubles = ("monthly_spend", "avg_order_value", "pages_per_session")
    parts = [f"{identifier} AS customer_id"]
    parts += [r6(c, c) if c in doubles else c for c in FEATURES]
    return f"SELECT {', '.join(parts)}, churned FROM {source}"
