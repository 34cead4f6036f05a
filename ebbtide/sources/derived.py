"""Customer, score and drift-pair tables derived from order data with DataFrame joins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import number_or_null

AS_OF = "2001-01-01"
WINDOW_DAYS = 720


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def customer_table(spark: SparkSession, folder: str, dirty=False, text_id=False) -> DataFrame:
    """One row per customer: segment columns, behaviour in the window and the attrition label.

    Line items are reduced to one row per order, and orders to one row per customer, before they meet the
    larger side, so every join has a unique key on both sides and a hot customer is pre-aggregated.
    """
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
        "o_orderdate",
        F.datediff(F.lit(AS_OF), F.to_date("o_orderdate")).alias("age"),
    )
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    )
    in_window = F.col("age").between(1, WINDOW_DAYS)
    past = F.col("age") > 0
    latest = F.when(past, F.struct(F.to_date("o_orderdate"), F.col("o_orderkey")))
    behaviour = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.max_by("o_orderpriority", latest).alias("device_type"),
            F.max(F.when(past, F.col("age"))).alias("account_age_days"),
            (F.sum(F.when(in_window, F.col("o_totalprice"))) / 24.0).alias("monthly_spend"),
            F.count_if(F.col("age").between(1, 360)).alias("num_orders_last_90d"),
            F.avg(F.when(in_window, F.col("o_totalprice"))).alias("avg_order_value"),
            F.sum(F.when(in_window, F.col("returned"))).alias("support_tickets_raised"),
            F.min(F.when(past, F.col("age"))).alias("days_since_last_login"),
            F.try_divide(
                F.sum(F.when(in_window, F.col("lines"))),
                F.count(F.when(in_window, F.col("lines"))),
            ).alias("pages_per_session"),
            F.count_if(F.col("age").between(-179, 0)).alias("later_orders"),
        )
    )
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = (
        table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(behaviour, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    age, spend, recency = (
        F.col("account_age_days"),
        F.col("monthly_spend"),
        F.col("days_since_last_login"),
    )
    if dirty:
        key = F.col("c_custkey")
        age = F.when(key % 200 == 0, F.lit(-1)).otherwise(age)
        recency = F.when(key % 160 == 1, F.lit(999)).when(key % 320 == 3, F.lit(-5)).otherwise(recency)
        spend = F.when(key % 76 == 2, spend * 100.0).otherwise(spend)
    identifier = F.col("c_custkey").cast("string") if text_id else F.col("c_custkey")
    return customers.select(
        identifier.alias(S.ID),
        F.col("r_name").alias("region"),
        F.col("device_type"),
        F.col("c_mktsegment").alias("subscription_plan"),
        age.cast("int").alias("account_age_days"),
        spend.alias("monthly_spend"),
        F.coalesce("num_orders_last_90d", F.lit(0)).cast("int").alias("num_orders_last_90d"),
        F.col("avg_order_value"),
        F.coalesce("support_tickets_raised", F.lit(0)).cast("int").alias("support_tickets_raised"),
        recency.cast("int").alias("days_since_last_login"),
        F.col("pages_per_session").cast("double").alias("pages_per_session"),
        F.when(F.coalesce("later_orders", F.lit(0)) > 0, 0).otherwise(1).alias(S.LABEL),
    )


def score_table(customers: DataFrame) -> DataFrame:
    """Two rational scores per customer: ``p_a`` (nearly distinct values) and ``p_b`` (heavy ties)."""
    r = F.coalesce("days_since_last_login", F.lit(0)).cast("double")
    a = F.coalesce("account_age_days", F.lit(0)).cast("double")
    return customers.select(
        S.ID,
        S.LABEL,
        (r / (r + a + 1.0)).alias("p_a"),
        (F.lit(1.0) / (F.col("num_orders_last_90d") + 1.0)).alias("p_b"),
    )


def line_score_table(spark: SparkSession, folder: str) -> DataFrame:
    """A large score table from line items: few distinct scores, many ties."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias(S.LABEL),
        ((F.col("l_quantity") + F.col("l_linenumber")) / 57.0).alias("score"),
    )


def halves_of_events(spark: SparkSession, folder: str):
    events = table(spark, folder, "events").select("event_type", number_or_null("value").alias("value"), "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")  # the column has no zone; the same type lets the scan filter
    return events.filter(F.col("ts") < cut).drop("ts"), events.filter(F.col("ts") >= cut).drop("ts")
