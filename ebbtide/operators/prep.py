"""Leak-free preparation as ``pyspark.ml`` stages.

``RangeRepair`` and ``DerivedFeatures`` are stateless. ``FeaturePrep`` learns clip bounds, medians, missing
indicators, scales, most frequent levels and one-hot levels, and its model turns a row into one feature
vector with built-in expressions only. ``learn_statistics`` learns the same numbers for many training folds
in the same few jobs. ``QuantileClip`` is the clipping step alone.
"""

import json
import math
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions import columns as X
from ebbtide.operators.ordering import order_values
from ebbtide.session import materialized, small_table

INDICATOR = "missingindicator_"
MAX_LEVELS = 100_000  # of one column in one split: levels become feature columns, so they must fit on the driver


@dataclass
class NumberStat:
    """What is learned for one numeric column."""

    name: str
    low: float | None = None
    high: float | None = None
    median: float | None = None
    had_missing: bool = False
    mean: float = 0.0
    scale: float = 1.0
    missing_mean: float = 0.0
    missing_scale: float = 1.0

    def clip(self, value):
        if self.low is None:
            return value
        return min(max(value, self.low), self.high)


@dataclass
class LevelStat:
    """What is learned for one categorical column."""

    name: str
    fill: str | None = None
    levels: list[str] = field(default_factory=list)


@dataclass
class PrepStatistics:
    numbers: list[NumberStat]
    levels: list[LevelStat]

    def to_json(self):
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text):
        raw = json.loads(text)
        return cls([NumberStat(**n) for n in raw["numbers"]], [LevelStat(**v) for v in raw["levels"]])

    def only(self, numeric, categorical):
        """The statistics of the named columns, in that order."""
        numbers, levels = ({s.name: s for s in stats} for stats in (self.numbers, self.levels))
        return PrepStatistics([numbers[c] for c in numeric], [levels[c] for c in categorical])

    @property
    def usable_numbers(self):
        """Columns with at least one value; a column that is empty in training carries no feature."""
        return [n for n in self.numbers if n.median is not None]

    def feature_names(self):
        kept = [n.name for n in self.usable_numbers]
        kept += [INDICATOR + n.name for n in self.numbers if n.had_missing]
        return kept + [f"{c.name}_{level}" for c in self.levels for level in c.levels]


def clip_bounds(df: DataFrame, columns, lower=S.CLIP_LOWER, upper=S.CLIP_UPPER) -> dict[str, tuple]:
    """Learned quantile bounds of the named columns that exist; missing values are ignored."""
    known = [c for c in columns if c in df.columns]
    if not known:
        return {}
    found = order_values(df, {c: X.number_or_null(c) for c in known}, {c: [lower, upper] for c in known})
    bounds = defaultdict(dict)
    for v in found:
        bounds[v.column][v.prob] = v.value
    return {c: (b[lower], b[upper]) for c, b in bounds.items()}


def clip_to_bounds(df: DataFrame, bounds) -> DataFrame:
    return df.withColumns(
        {c: X.clipped(X.number_or_null(c), F.lit(low), F.lit(high)) for c, (low, high) in bounds.items()}
    )


def repair_ranges(df: DataFrame, ranges=None) -> DataFrame:
    ranges = ranges or S.VALID_RANGES
    return df.withColumns({c: X.repaired(c, *r) for c, r in ranges.items() if c in df.columns})


def add_derived_features(df: DataFrame, dormant_after=S.DORMANT_AFTER_DAYS) -> DataFrame:
    return df.withColumns(
        {
            "recency_ratio": X.recency_ratio(),
            "is_dormant": X.is_dormant(dormant_after),
            "support_per_order": X.support_per_order(),
        }
    )


def _spread(value):
    return value if value else 1.0


def learn_statistics(df: DataFrame, numeric=None, categorical=None, clipped=None, lower=S.CLIP_LOWER,
                     upper=S.CLIP_UPPER, group=None) -> dict[str, PrepStatistics]:
    """Preparation statistics per value of ``group`` (or under the key ``None``), in four jobs in total.

    ``group`` names a column with few values, such as the training split a row belongs to. Clipping keeps the
    order of values, so the median after clipping comes from the same ranks as before it.
    """
    numeric = S.MODEL_NUMERIC if numeric is None else numeric
    categorical = S.CATEGORICAL if categorical is None else categorical
    clipped = S.CLIPPED if clipped is None else clipped
    by = [group] if group else []
    key = (lambda row: row[group]) if group else (lambda row: None)
    numbers: dict[str, dict[str, NumberStat]] = {}
    if numeric:
        probs = {c: sorted({lower, 0.5, upper}) if c in clipped else [0.5] for c in numeric}
        found = order_values(df, {c: X.number_or_null(c) for c in numeric}, probs, by)
        groups = defaultdict(lambda: defaultdict(dict))
        for v in found:
            groups[v.group[0] if by else None][v.column][v.prob] = v
        numbers = {g: {c: NumberStat(c) for c in numeric} for g in groups}
        for g, columns in groups.items():
            for name, marks in columns.items():
                stat = numbers[g][name]
                if name in clipped:
                    stat.low, stat.high = marks[lower].value, marks[upper].value
                middle = marks[0.5]
                start, stop = stat.clip(middle.low), stat.clip(middle.high)
                stat.median = start + (stop - start) * middle.fraction
        _learn_scales(df, numeric, by, key, numbers)
    levels = _learn_levels(df, categorical, by, key) if categorical else {}
    keys = set(numbers) | set(levels)
    return {
        g: PrepStatistics(
            list(numbers[g].values()) if g in numbers else [],
            levels.get(g, [LevelStat(c) for c in categorical]),
        )
        for g in keys
    }


def _learn_scales(df, numeric, by, key, numbers):
    """Mean and population deviation after clipping and filling, and the share of missing values."""
    spark = df.sparkSession
    rows = [(g, n.name, n.low, n.high, n.median) for g, cs in numbers.items() for n in cs.values()]
    kind = df.schema[by[0]].dataType.simpleString() if by else "string"
    learned = small_table(spark, rows, f"_g {kind}, _c string, low double, high double, median double")
    entries = [F.struct(F.lit(c).alias("_n"), X.number_or_null(c).alias("value")) for c in numeric]
    long = df.select(*by, F.inline(F.array(*entries)))
    match = F.col("_n") == F.col("_c")
    if by:
        match = match & F.col(by[0]).eqNullSafe(F.col("_g"))
    value = F.coalesce(
        F.when(F.col("low").isNull(), F.col("value")).otherwise(
            X.clipped(F.col("value"), F.col("low"), F.col("high"))
        ),
        F.col("median"),
    )
    stats = (
        long.join(F.broadcast(learned), match)  # one row per group and column
        .groupBy(*by, "_n")
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.avg(F.col("value").isNull().cast("double")).alias("missing"),
        )
        .collect()
    )
    for row in stats:
        stat = numbers[key(row)][row["_n"]]
        share = row["missing"]
        stat.had_missing = share > 0
        stat.missing_mean = share
        stat.missing_scale = _spread((share * (1.0 - share)) ** 0.5)
        if stat.median is not None:
            stat.mean, stat.scale = row["mean"], _spread(row["std"])


def _learn_levels(df, categorical, by, key):
    """Most frequent level (smallest on ties) and all levels in text order."""
    entries = [F.struct(F.lit(c).alias("_n"), F.col(c).cast("string").alias("level")) for c in categorical]
    counted = (
        df.select(*by, F.inline(F.array(*entries)))
        .filter(F.col("level").isNotNull())
        .groupBy(*by, "_n", "level")
        .count()
    )
    counted = materialized(counted, "levels")
    largest = counted.groupBy(*by, "_n").count().orderBy(F.desc("count")).first()
    if largest is not None and largest["count"] > MAX_LEVELS:
        raise ValueError(
            f"{largest['_n']} has {largest['count']} levels in one split, more than {MAX_LEVELS}; map it to fewer first"
        )
    counts = counted.collect()
    seen = defaultdict(lambda: defaultdict(list))
    for row in counts:
        seen[key(row)][row["_n"]].append((-row["count"], row["level"]))
    out = {}
    for g, columns in seen.items():
        out[g] = [
            LevelStat(c, min(columns[c])[1] if columns[c] else None, sorted(level for _, level in columns[c]))
            for c in categorical
        ]
    return out


def _double(value):
    """A double as SQL text; ``repr`` reads back to the same bits."""
    value = float(value)
    return f"({value!r}D)" if math.isfinite(value) else f"CAST('{value!r}' AS DOUBLE)"


def _text(value):
    """A string as SQL text, whatever quotes it holds."""
    return f"CAST(X'{value.encode().hex()}' AS STRING)"


def _name(column):
    return "`" + column.replace("`", "``") + "`"


def prepared_texts(stats: PrepStatistics) -> dict[str, str]:
    """Name to SQL text for every prepared feature, in vector order.

    Each feature is one branch between a constant and one arithmetic step. Several prepared vectors share a
    generated method when members of an ensemble score a row, so their code must stay small. Text is parsed in one call;
    column objects take hundreds of calls a vector, and a training run makes about a hundred vectors.
    """
    out = {}
    for n in stats.usable_numbers:
        value = f"nanvl(try_cast({_name(n.name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
        kept = value if n.low is None else f"least(greatest({value}, {_double(n.low)}), {_double(n.high)})"
        scaled = f"({kept} - {_double(n.mean)}) * {_double(1.0 / n.scale)}"
        filled = _double((n.median - n.mean) / n.scale)
        out[n.name] = f"CASE WHEN {value} IS NOT NULL THEN {scaled} ELSE {filled} END"
    for n in stats.numbers:
        if n.had_missing:
            value = f"nanvl(try_cast({_name(n.name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            present = _double((0.0 - n.missing_mean) / n.missing_scale)
            missing = _double((1.0 - n.missing_mean) / n.missing_scale)
            out[INDICATOR + n.name] = f"CASE WHEN {value} IS NULL THEN {missing} ELSE {present} END"
    for c in stats.levels:
        value = f"CAST({_name(c.name)} AS STRING)"
        for level in c.levels:
            hit = f"{value} = {_text(level)}"
            if level == c.fill:
                hit = f"{value} IS NULL OR {hit}"
            out[f"{c.name}_{level}"] = f"CASE WHEN {hit} THEN 1.0D ELSE 0.0D END"
    return out


def prepared_expressions(stats: PrepStatistics) -> dict:
    """Name to expression for every prepared feature, in vector order."""
    return {name: F.expr(text) for name, text in prepared_texts(stats).items()}


class _OutputCol(Params):
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def getOutputCol(self):
        return self.getOrDefault(self.outputCol)


class RangeRepair(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Out-of-range values become NULL by fixed rules."""

    ranges = Param(Params._dummy(), "ranges", "JSON of column -> [low, high]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, ranges=None):
        super().__init__()
        self._setDefault(ranges=json.dumps(S.VALID_RANGES))
        if ranges is not None:
            self._set(ranges=ranges if isinstance(ranges, str) else json.dumps(ranges))

    def _transform(self, dataset):
        return repair_ranges(dataset, json.loads(self.getOrDefault(self.ranges)))


class DerivedFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the three derived behaviour features."""

    dormantAfter = Param(Params._dummy(), "dormantAfter", "days until dormant", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, dormantAfter=S.DORMANT_AFTER_DAYS):
        super().__init__()
        self._setDefault(dormantAfter=S.DORMANT_AFTER_DAYS)
        self._set(dormantAfter=dormantAfter)

    def _transform(self, dataset):
        return add_derived_features(dataset, self.getOrDefault(self.dormantAfter))


class QuantileClip(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns quantile bounds for the named columns (all numeric ones by default)."""

    columns = Param(Params._dummy(), "columns", "columns to clip", TypeConverters.toListString)
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns=None, lower=S.CLIP_LOWER, upper=S.CLIP_UPPER):
        super().__init__()
        self._setDefault(lower=S.CLIP_LOWER, upper=S.CLIP_UPPER)
        self._set(lower=lower, upper=upper)
        if columns is not None:
            self._set(columns=columns)

    def _fit(self, dataset):
        if self.isDefined(self.columns):
            columns = self.getOrDefault(self.columns)
        else:
            numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
            columns = [c for c, t in dataset.dtypes if t.startswith(numeric)]
        bounds = clip_bounds(dataset, columns, self.getOrDefault(self.lower), self.getOrDefault(self.upper))
        return QuantileClipModel(bounds=json.dumps(bounds))


class QuantileClipModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    bounds = Param(Params._dummy(), "bounds", "JSON of column -> [low, high]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, bounds=None):
        super().__init__()
        if bounds is not None:
            self._set(bounds=bounds)

    def _transform(self, dataset):
        return clip_to_bounds(dataset, json.loads(self.getOrDefault(self.bounds)))


class FeaturePrep(Estimator, _OutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns all preparation statistics on the rows it is fitted on."""

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    clipped = Param(Params._dummy(), "clipped", "columns to clip", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None, clipped=None, outputCol="features"):
        super().__init__()
        self._set(
            numeric=S.MODEL_NUMERIC if numeric is None else numeric,
            categorical=S.CATEGORICAL if categorical is None else categorical,
            clipped=S.CLIPPED if clipped is None else clipped,
            outputCol=outputCol,
        )

    def _fit(self, dataset):
        stats = learn_statistics(
            dataset,
            self.getOrDefault(self.numeric),
            self.getOrDefault(self.categorical),
            self.getOrDefault(self.clipped),
        )
        return FeaturePrepModel(statistics=stats[None].to_json(), outputCol=self.getOutputCol())


class FeaturePrepModel(Model, _OutputCol, DefaultParamsReadable, DefaultParamsWritable):
    statistics = Param(Params._dummy(), "statistics", "learned statistics as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, statistics=None, outputCol="features"):
        super().__init__()
        self._set(outputCol=outputCol)
        if statistics is not None:
            self._set(statistics=statistics)

    @property
    def learned(self):
        return PrepStatistics.from_json(self.getOrDefault(self.statistics))

    @property
    def feature_names(self):
        return self.learned.feature_names()

    def _transform(self, dataset):
        features = F.expr(f"array({', '.join(prepared_texts(self.learned).values())})")
        return dataset.withColumn(self.getOutputCol(), array_to_vector(features))
