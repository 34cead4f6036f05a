"""A stored reference for drift: value cells and row counts that later days add to, so its rows are not read again.

A profile is one long table ``(feature, kind, value, level, n)``: rows per distinct number (kind ``number``), rows
per category level (kind ``level``) and all rows (kind ``rows``); missing values have no value or level. Counts
add up, so profiles of two days merge into the profile of both. Decile edges, bins, PSI and KS are derived from the
cells and equal those of the two tables.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import drift_band, number_or_null
from ebbtide.operators import drift, ordering
from ebbtide.session import materialized

SCHEMA = "feature string, kind string, value double, level string, n bigint"


def profile_of(df: DataFrame, numeric=None, categorical=None) -> DataFrame:
    """The profile of a table; one scan, and rows of equal values are added up before they move."""
    numeric = list(S.NUMERIC if numeric is None else numeric)
    categorical = list(S.CATEGORICAL if categorical is None else categorical)

    def entry(feature, kind, value=None, level=None):
        return F.struct(
            F.lit(feature).alias("feature"),
            F.lit(kind).alias("kind"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if level is None else level).cast("string").alias("level"),
        )

    entries = [entry("", "rows")]
    entries += [entry(c, "number", value=number_or_null(c)) for c in numeric]
    entries += [entry(c, "level", level=F.col(c)) for c in categorical]
    long = df.select(F.inline(F.array(*entries)))
    return long.groupBy("feature", "kind", "value", "level").agg(F.count("*").alias("n"))


def merged(*profiles: DataFrame) -> DataFrame:
    """One profile of the rows of all of them."""
    together = profiles[0]
    for other in profiles[1:]:
        together = together.unionByName(other)
    return together.groupBy("feature", "kind", "value", "level").agg(F.sum("n").alias("n"))


def write_profile(profile: DataFrame, path, mode="errorifexists") -> str:
    """Store a profile; with mode ``append`` a day is added, and readers add the counts up."""
    profile.write.mode(mode).parquet(str(path))
    return str(path)


def read_profile(spark, path) -> DataFrame:
    return merged(spark.read.schema(SCHEMA).parquet(str(path)))


def profile_edges(profile: DataFrame, bins=S.PSI_BINS, edges=None) -> dict[str, list[float]]:
    """Distinct interpolated quantiles of every numeric feature of a profile, from cells alone.

    Cumulative rows are exact; one row for each feature comes to the driver.
    """
    numbers = profile.filter("kind = 'number' AND value IS NOT NULL").select("feature", "value", "n")
    edges = _cell_edges(numbers) if edges is None else edges
    upto = ordering.running_totals(numbers, ["feature"], "value", ["n"], edges)
    places = [(i / bins) * (F.col("n_total") - 1) for i in range(bins + 1)]
    at = lambda rank: F.min(F.when(F.col("n_upto") > rank, F.col("value")))
    found = upto.groupBy("feature").agg(
        F.max("n_total").alias("size"),
        F.array(*[at(F.floor(p)) for p in places]).alias("low"),
        F.array(*[at(F.least(F.floor(p) + 1, F.col("n_total") - 1)) for p in places]).alias("high"),
    )
    out = {r["feature"]: set() for r in profile.filter("kind = 'number'").select("feature").distinct().collect()}
    for row in found.collect():
        for i in range(bins + 1):
            place = (i / bins) * (row["size"] - 1)
            low, high = row["low"][i], row["high"][i]
            # equal ends may be infinite, and infinity has no distance to itself
            out[row["feature"]].add(low if low == high else low + (high - low) * (place - math.floor(place)))
    return {feature: sorted(marks) for feature, marks in out.items()}


def _cell_edges(numbers):
    """Split points of distinct values, each counted once: pieces then hold equal numbers of cells."""
    return ordering.value_edges(numbers, "value")


def profile_drift(reference: DataFrame, current: DataFrame, bins=S.PSI_BINS) -> DataFrame:
    """PSI and KS per feature of two profiles, equal to ``drift.feature_drift`` of their tables."""
    sides = materialized(
        reference.withColumn("side", F.lit("ref"))
        .unionByName(current.withColumn("side", F.lit("cur")))
        .groupBy("feature", "kind", "value", "level")
        .agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("ref", "cur")]),
        "drift-cells",
    )
    numbers = sides.filter("kind = 'number' AND value IS NOT NULL").select("feature", "value", "ref", "cur")
    edges = _cell_edges(numbers)
    marks = profile_edges(sides.filter("ref > 0").withColumn("n", F.col("ref")), bins, edges)
    level = F.coalesce("level", F.lit(S.MISSING_LEVEL)).alias("level")
    levels = sides.filter("kind = 'level'").select("feature", level, "ref", "cur")
    # a feature that has numbers on the current side only has no edges
    current_only = {r["feature"]: [] for r in numbers.select("feature").distinct().collect()}
    numeric_levels = drift.binned(numbers, {**current_only, **marks})
    if numeric_levels is not None:
        levels = levels.unionByName(numeric_levels)
    counts = levels.groupBy("feature", "level").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    psi = drift.psi_from_counts(counts, by=["feature"])
    missing = sides.filter("kind <> 'rows'").groupBy("feature", "kind").agg(
        F.sum("cur").alias("_rows"),
        F.sum(F.when(F.col("level").isNull() & F.col("value").isNull(), F.col("cur")).otherwise(0)).alias("_missing"),
    )
    ks = drift.cells_ks(numbers, edges)
    is_number = F.col("kind") == "number"
    one_sided = (F.coalesce("ref_rows", F.lit(0)) == 0) | (F.coalesce("cur_rows", F.lit(0)) == 0)
    value = F.when(is_number & one_sided, 0.0).otherwise(F.coalesce("psi", F.lit(0.0)))
    return (
        missing.join(psi, "feature", "left")
        .join(ks, "feature", "left")
        .select(
            "feature",
            value.alias("psi"),
            F.when(is_number, F.coalesce("ks", F.lit(0.0))).alias("ks"),
            F.try_divide("_missing", "_rows").alias("cur_missing"),
        )
        .withColumn("band", drift_band(F.col("psi")))
        .orderBy(F.col("psi").desc(), F.col("feature"))
    )


def row_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``(side, rows)`` of two profiles."""
    sides = [p.filter("kind = 'rows'").select(F.lit(s).alias("side"), "n") for s, p in
             (("ref", reference), ("cur", current))]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.sum("n").alias("rows"))
