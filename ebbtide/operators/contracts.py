"""Table contracts, row checks and per-column quality counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import number_or_null, outside


class ContractError(ValueError):
    """A table does not satisfy the customer contract."""


def absent_columns(df: DataFrame, require_label=True) -> list[str]:
    needed = [S.ID, *S.RAW_FEATURES] + ([S.LABEL] if require_label else [])
    return [c for c in needed if c not in df.columns]


def column_contract(df: DataFrame, require_label=True) -> DataFrame:
    """One row per required column: is it there, with which type, in how many rows, and how often missing.

    An absent column is missing in every row; NaN is missing, too. All columns are counted in one pass.
    """
    needed = [S.ID, *S.RAW_FEATURES] + ([S.LABEL] if require_label else [])
    types = dict(df.dtypes)
    rows = []
    for c in needed:
        if c not in types:
            present = F.lit(0).cast("long")
        elif types[c] in ("double", "float"):
            present = F.count_if(F.col(c).isNotNull() & ~F.isnan(c))
        else:
            present = F.count(c)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in types).alias("present"),
                F.lit(types.get(c)).cast("string").alias("type"),
                F.count("*").alias("n_rows"),
                (F.count("*") - present).alias("missing"),
            )
        )
    return df.agg(F.array(*rows).alias("columns")).select(F.inline("columns"))


def repeated_keys(df: DataFrame, key=S.ID) -> DataFrame:
    """Keys that occur more than once; missing keys count as equal to each other."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def foreign_labels(df: DataFrame, label=S.LABEL) -> DataFrame:
    """Distinct label values other than 0 and 1; missing labels are ignored."""
    return df.filter(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).select(label).distinct()


def check_contract(df: DataFrame, require_label=True) -> None:
    """Raise ContractError on absent columns, repeated keys or a label that is not 0/1."""
    absent = absent_columns(df, require_label)
    if absent:
        raise ContractError(f"required columns are absent: {absent}")
    repeated = repeated_keys(df).first()
    if repeated is not None:
        raise ContractError(f"{S.ID} is not unique, for example {repeated[0]!r} ({repeated[1]} rows)")
    if S.LABEL in df.columns:
        foreign = foreign_labels(df).first()
        if foreign is not None:
            raise ContractError(f"{S.LABEL} must be 0 or 1, found {foreign[0]!r}")


def modelling_columns(df: DataFrame) -> DataFrame:
    """Id, integer label and features together; rows are never matched by position."""
    features = [c for c in df.columns if c not in (S.ID, S.LABEL)]
    return df.select(S.ID, F.col(S.LABEL).cast("int").alias(S.LABEL), *features)


def with_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: the request rules each row breaks, in feature order."""
    rules = []
    for column in S.RAW_FEATURES:
        if column in S.NUMERIC:
            value = number_or_null(column)
            if column not in S.NULLABLE_FEATURES:
                rules.append(F.when(value.isNull(), F.lit(f"{column} is missing")))
            rules.append(F.when(value < 0, F.lit(f"{column} is negative")))
        else:
            rules.append(F.when(F.col(column).isNull(), F.lit(f"{column} is missing")))
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def split_valid(df: DataFrame):
    """Valid rows, and quarantined rows with the rules they break."""
    checked = with_violations(df)
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)


def quality_counts(df: DataFrame) -> DataFrame:
    """Missing and out-of-range counts per feature in one aggregate.

    Missing is counted on the raw value; unparsable text is neither missing nor out of range; an absent column
    is missing in every row. Both range ends are valid values.
    """
    counts = []
    for column in S.RAW_FEATURES:
        if column not in df.columns:
            missing, invalid = F.count("*"), F.lit(0).cast("long")
        else:
            raw = F.col(column)
            empty = raw.isNull() | F.isnan(raw) if dict(df.dtypes)[column] in ("double", "float") else raw.isNull()
            missing = F.count_if(empty)
            low, high = S.VALID_RANGES.get(column, (None, None))
            invalid = F.count_if(outside(number_or_null(column), low, high))
        counts.append(
            F.struct(F.lit(column).alias("column"), missing.alias("missing"), invalid.alias("invalid_range"))
        )
    return df.agg(F.array(*counts).alias("_q")).select(F.inline("_q"))
