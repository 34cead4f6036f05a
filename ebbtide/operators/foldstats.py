"""Preparation statistics of many "all but one fold" splits from summaries of the folds.

A fold scheme deals rows to folds; a training split is its scheme without one fold. Counts, sums and value counts of a
fold are taken away from those of the whole scheme, so each row is summed up once for each scheme (eight for a training
run) and never for each of the 46 splits. Quantiles stay exact: one sketch of the whole table brackets each rank, folds
count their rows below and inside the bracket, a bracket that holds many rows is cut at the bins that some split still
needs, and the few values left inside are counted by fold. Means and deviations after clipping come from the same
counts: values outside the brackets by their sums, values inside one by one.
"""

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import number_or_null
from ebbtide.operators.prep import MAX_LEVELS, LevelStat, NumberStat, PrepStatistics

SKETCH_ACCURACY = 10_000
#: A bracket reaches this far (in shares of the rows) beyond its rank, and at least SPREAD standard errors of a split.
LEAST_SLACK, SPREAD = 3e-4, 4.0
#: Rows of a bracket whose values come to the driver; larger brackets are cut into BINS first.
VALUES, BINS = 2_000, 400


@dataclass(frozen=True)
class Scheme:
    """A way to deal rows to folds: ``fold`` is NULL for rows the scheme leaves out."""

    key: str
    fold: Column


def _memberships(df: DataFrame, schemes, columns) -> DataFrame:
    """A row for each scheme a row belongs to: scheme number, fold, columns."""
    parts = [F.when(s.fold.isNotNull(), F.struct(F.lit(i).alias("scheme"), s.fold.cast("int").alias("fold"))) for i, s in enumerate(schemes)]
    return df.select(*columns, F.inline(F.array_compact(F.array(*parts))))


@dataclass
class _Bracket:
    column: str
    prob: float
    low: float
    high: float


def _brackets(df, numbers, probs):
    """Brackets around each wanted rank of the whole table, and the ends of each column."""
    names = list(numbers)
    sizes = df.agg(
        F.count("*").alias("n"), *[F.struct(F.min(e).alias("low"), F.max(e).alias("high")).alias(c) for c, e in numbers.items()]
    ).first()
    slack = max(LEAST_SLACK, SPREAD / max(sizes["n"], 1) ** 0.5)
    wanted = {c: sorted({min(1.0, max(0.0, p + d)) for p in probs[c] for d in (-slack, slack)}) for c in names}
    marks = df.agg(*[F.percentile_approx(numbers[c], wanted[c], SKETCH_ACCURACY).alias(c) for c in names]).first()
    ends = {c: (sizes[c]["low"], sizes[c]["high"]) for c in names}
    found = []
    for c in names:
        if ends[c][0] is None:
            continue
        at = dict(zip(wanted[c], marks[c]))
        for p in probs[c]:
            low, high = max(0.0, p - slack), min(1.0, p + slack)
            found.append(_Bracket(c, p, ends[c][0] if low == 0.0 else at[low], ends[c][1] if high == 1.0 else at[high]))
    return found, ends


class FoldStatistics:
    """Summaries of every fold of every scheme, and the statistics of any scheme without any of its folds."""

    def __init__(self, df: DataFrame, schemes, numeric, categorical, clipped=None, lower=S.CLIP_LOWER, upper=S.CLIP_UPPER,
                 label=S.LABEL):
        self.df, self.schemes = df, list(schemes)
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.clipped = S.CLIPPED if clipped is None else clipped
        self.lower, self.upper, self.label = lower, upper, label
        self.probs = {c: sorted({lower, 0.5, upper}) if c in self.clipped else [0.5] for c in self.numeric}
        self.numbers = {c: number_or_null(c) for c in self.numeric}
        self.brackets, ends = _brackets(df, self.numbers, self.probs) if self.numeric else ([], {})
        self._count()
        self._repair(ends)
        self._narrow()
        self._read_values()
        self._sum_outside()
        self._count_levels()

    # -- jobs, each one scan with a row for each fold in every task's result -----------------------------------

    def _cells(self, entries, columns=()):
        """{(scheme, fold): row} of aggregates over the memberships."""
        values = [e.alias(f"v_{c}") for c, e in self.numbers.items()]
        rows = _memberships(self.df, self.schemes, [*values, *columns])
        return {(r["scheme"], r["fold"]): r for r in rows.groupBy("scheme", "fold").agg(*entries).collect()}

    def _count(self):
        entries = [F.count("*").alias("rows"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")]
        entries += [F.count(f"v_{c}").alias(f"n_{c}") for c in self.numeric]
        for i, b in enumerate(self.brackets):
            value = F.col(f"v_{b.column}")
            entries.append(F.count_if(value < b.low).alias(f"below_{i}"))
            entries.append(F.count_if(value.between(b.low, b.high)).alias(f"inside_{i}"))
        found = self._cells(entries, [F.col(self.label).alias("y")])
        self.cells = dict(sorted(found.items()))

    def sizes(self, scheme, fold=None):
        """Rows of the whole scheme without a fold."""
        return self._left("rows", scheme, fold)

    def fold_labels(self, scheme, fold):
        """(positives, negatives) of one fold."""
        cell = self.cells.get((scheme, fold))
        return (cell["pos"], cell["neg"]) if cell else (0, 0)

    def _left(self, name, scheme, fold, cells=None):
        cells = self.cells if cells is None else cells
        return sum(r[name] for (s, f), r in cells.items() if s == scheme and f != fold)

    def splits(self):
        """(scheme, fold left out) of every split, and (scheme, None) for whole schemes."""
        return [*self.cells, *sorted({(s, None) for s, _ in self.cells}, key=str)]

    def _by_cell(self, found, key):
        """(ascending keys, a row of counts by cell for each)."""
        place = {cell: k for k, cell in enumerate(self.cells)}
        keys, row = np.unique(found[key].to_numpy(), return_inverse=True)
        counts = np.zeros((len(keys), len(place)), np.int64)
        np.add.at(counts, (row, [place[c] for c in zip(found["scheme"], found["fold"])]), found["n"].to_numpy())
        return keys, counts

    def _without(self, per_cell, scheme, fold):
        """Counts of a scheme without a fold."""
        return per_cell[:, [s == scheme and f != fold for s, f in self.cells]].sum(axis=1)

    def _ranks(self, column, prob, scheme, fold):
        size = self._left(f"n_{column}", scheme, fold)
        place = prob * (size - 1)
        low = int(place // 1)
        return low, min(low + 1, size - 1), place - low, size

    def _repair(self, ends):
        """A bracket that misses some split's rank is opened to the ends of its column."""
        changed = False
        for i, b in enumerate(self.brackets):
            for scheme, fold in self.splits():
                low, high, _, size = self._ranks(b.column, b.prob, scheme, fold)
                below = self._left(f"below_{i}", scheme, fold)
                if size and not (below <= low and high < below + self._left(f"inside_{i}", scheme, fold)):
                    b.low, b.high = ends[b.column]
                    changed = True
                    break
        if changed:
            self._count()

    def _held(self, i):
        return sum(self.cells[k][f"inside_{i}"] for k in self.cells)

    def _narrow(self):
        """Cut brackets of many rows at the bins that hold some split's rank, as long as that makes them smaller."""
        stuck = set()
        while wide := [i for i, b in enumerate(self.brackets) if self._held(i) > VALUES * len(self.schemes) and b.low < b.high and i not in stuck]:
            parts = []
            for i in wide:
                b = self.brackets[i]
                value, width = F.col(f"v_{b.column}"), (b.high - b.low) / BINS
                bin_of = F.least(F.floor((value - b.low) / width), F.lit(BINS - 1)).cast("int")
                parts.append(F.when(value.between(b.low, b.high), F.struct(F.lit(i).alias("i"), bin_of.alias("bin"), value.alias("value"))))
            values = [e.alias(f"v_{c}") for c, e in self.numbers.items()]
            rows = _memberships(self.df, self.schemes, values).select("scheme", "fold", F.inline(F.array_compact(F.array(*parts))))
            counted = rows.groupBy("scheme", "fold", "i", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            # At most BINS rows for each fold and bracket.
            for i, found in counted.toPandas().groupby("i"):
                b, before = self.brackets[i], (self.brackets[i].low, self.brackets[i].high)
                bins, per_cell = self._by_cell(found, "bin")
                needed = []
                for scheme, fold in self.splits():
                    low, high, _, size = self._ranks(b.column, b.prob, scheme, fold)
                    if size:
                        upto = self._left(f"below_{i}", scheme, fold) + np.cumsum(self._without(per_cell, scheme, fold))
                        needed += [np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high, side="right")]
                held = found[found["bin"].between(bins[min(needed)], bins[max(needed)])]
                b.low, b.high = float(held["low"].min()), float(held["high"].max())
                if (b.low, b.high) == before:
                    stuck.add(i)
            self._count()

    def _read_values(self):
        """Distinct values inside the brackets with their number of rows in each fold."""
        parts = [
            F.when(F.col(f"v_{b.column}").between(b.low, b.high), F.struct(F.lit(i).alias("i"), F.col(f"v_{b.column}").alias("value")))
            for i, b in enumerate(self.brackets)
        ]
        self.values = {}  # bracket to (ascending values, rows of each value in each fold)
        if not parts:
            return
        values = [e.alias(f"v_{c}") for c, e in self.numbers.items()]
        rows = _memberships(self.df, self.schemes, values).select("scheme", "fold", F.inline(F.array_compact(F.array(*parts))))
        counted = rows.groupBy("i", "value", "scheme", "fold").agg(F.count("*").alias("n"))
        for i, found in counted.toPandas().groupby("i"):
            self.values[i] = self._by_cell(found, "value")

    def _center(self, column):
        return next((b.low for b in self.brackets if b.column == column and b.prob == 0.5), 0.0)

    def _sum_outside(self):
        """Sums of what no clip bound of any split can change, around a value of the column's middle."""
        entries = [F.count("*").alias("rows")]
        for c in self.numeric:
            low, high = self._clip_brackets(c)
            value = F.col(f"v_{c}")
            kept = value.isNotNull() if low is None else (value > low.high) & (value < high.low)
            away = F.when(kept, value - self._center(c))
            entries += [F.count(away).alias(f"k_{c}"), F.coalesce(F.sum(away), F.lit(0.0)).alias(f"s_{c}")]
            entries.append(F.coalesce(F.sum(away * away), F.lit(0.0)).alias(f"q_{c}"))
        self.sums = self._cells(entries) if self.numeric else {}

    def _clip_brackets(self, column):
        """The brackets of a clipped column's bounds; none where they meet, or where the column is not clipped."""
        if column not in self.clipped:
            return None, None
        own = {b.prob: b for b in self.brackets if b.column == column}
        return own.get(self.lower), own.get(self.upper)

    def _count_levels(self):
        self.levels = defaultdict(lambda: defaultdict(dict))  # column -> level -> (scheme, fold) -> n
        for c in self.categorical:  # one aggregate for each column: no row is there once for each column
            rows = _memberships(self.df, self.schemes, [F.col(c).cast("string").alias("level")])
            counted = rows.filter("level IS NOT NULL").groupBy("level", "scheme", "fold").agg(F.count("*").alias("n"))
            found = counted.limit(MAX_LEVELS * len(self.cells) + 1).collect()
            for r in found:
                self.levels[c][r["level"]][r["scheme"], r["fold"]] = r["n"]
            if len(self.levels[c]) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels; map it to fewer first")

    # -- what the driver makes of them -------------------------------------------------------------------------

    def _value_at(self, i, scheme, fold):
        """(value at the low rank, value at the high rank, fraction) of a bracket's probability."""
        b = self.brackets[i]
        low, high, fraction, _ = self._ranks(b.column, b.prob, scheme, fold)
        values, per_cell = self.values[i]
        upto = self._left(f"below_{i}", scheme, fold) + np.cumsum(self._without(per_cell, scheme, fold))
        first, last = np.searchsorted(upto, [low, high], side="right")
        return float(values[first]), float(values[last]), fraction

    def _number(self, column, scheme, fold):
        stat = NumberStat(column)
        rows, present = self._left("rows", scheme, fold), self._left(f"n_{column}", scheme, fold)
        share = (rows - present) / rows if rows else 0.0
        stat.had_missing = present < rows
        stat.missing_mean, stat.missing_scale = share, (share * (1.0 - share)) ** 0.5 or 1.0
        if not present:
            return stat
        own = {b.prob: i for i, b in enumerate(self.brackets) if b.column == column}
        marks = {p: self._value_at(i, scheme, fold) for p, i in own.items()}
        between = lambda m: m[0] if m[0] == m[1] else m[0] + (m[1] - m[0]) * m[2]
        if column in self.clipped:
            stat.low, stat.high = between(marks[self.lower]), between(marks[self.upper])
        start, stop, fraction = stat.clip(marks[0.5][0]), stat.clip(marks[0.5][1]), marks[0.5][2]
        stat.median = start + (stop - start) * fraction
        center = self._center(column)
        n = self._left(f"k_{column}", scheme, fold, self.sums)
        total, squares = (self._left(f"{m}_{column}", scheme, fold, self.sums) for m in "sq")
        if column in self.clipped:
            # Below the lower bracket, in the brackets value by value, above the upper bracket.
            low, high = own[self.lower], own[self.upper]
            size = self._left(f"n_{column}", scheme, fold)
            loose = {}
            for i in (low, high):
                values, per_cell = self.values[i]
                loose |= zip(values.tolist(), self._without(per_cell, scheme, fold).tolist())
            # A bracket that was opened may reach over the other one's outer end.
            inner = self.brackets[low].low, self.brackets[high].high
            loose = {v: k for v, k in loose.items() if inner[0] <= v <= inner[1]}
            below = self._left(f"below_{low}", scheme, fold)
            above = size - self._left(f"below_{high}", scheme, fold) - self._left(f"inside_{high}", scheme, fold)
            groups = [(stat.low, below), (stat.high, above), *((stat.clip(v), k) for v, k in loose.items())]
            for value, k in groups:
                n, total, squares = n + k, total + k * (value - center), squares + k * (value - center) ** 2
        missing = rows - present
        n, total, squares = n + missing, total + missing * (stat.median - center), squares + missing * (stat.median - center) ** 2
        stat.mean = center + total / n
        stat.scale = max(squares / n - (total / n) ** 2, 0.0) ** 0.5 or 1.0
        return stat

    def statistics(self, scheme, fold=None) -> PrepStatistics:
        """The statistics of a scheme's rows without those of a fold (None: of all its rows)."""
        levels = []
        for c in self.categorical:
            counts = {v: sum(n for (s, f), n in cells.items() if s == scheme and f != fold) for v, cells in self.levels[c].items()}
            kept = {v: n for v, n in counts.items() if n}
            fill = min(((-n, v) for v, n in kept.items()), default=(0, None))[1]
            levels.append(LevelStat(c, fill, sorted(kept)))
        return PrepStatistics([self._number(c, scheme, fold) for c in self.numeric], levels)
