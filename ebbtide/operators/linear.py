"""Many penalised logistic fits in the same few passes over the rows.

A training run fits the linear model on dozens of overlapping splits. Newton's method needs the gradient and the matrix of
second derivatives of each split, which are sums over rows: every pass reads the rows once, adds both up for all splits
and sends only sums back. Prepared features of all splits are linear in shared columns (a constant, numbers, marks of
missing numbers, levels); only the numbers that are clipped differ from split to split. So rows are laid out once and the
driver turns the sums into those of each split's own features. Five to eight passes reach the optimum of the same
objective as ``LogisticRegression``: the sum of losses plus half the squared coefficients, without the intercept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import number_or_null
from ebbtide.operators.prep import PrepStatistics

#: Second derivatives of this many shared columns are summed up; wider splits are fitted one by one.
MAX_COLUMNS = 200
#: A step that promises less than this many units of log-likelihood is the last one (a ten-thousandth standard error).
LAST_GAIN = 1e-8
#: Losses of two passes may differ by this share because sums are added in another order.
LOSS_NOISE = 1e-12


@dataclass
class Layout:
    """The shared columns: constant, numbers, marks of missing numbers, levels and missing levels of each category."""

    numbers: list[str]
    center: np.ndarray
    width: np.ndarray
    levels: dict[str, list[str]]

    @property
    def size(self):
        return 1 + 2 * len(self.numbers) + sum(len(v) + 1 for v in self.levels.values())

    def starts(self):
        """First place of each category; its missing level comes before its levels."""
        at, found = 1 + 2 * len(self.numbers), {}
        for name, levels in self.levels.items():
            found[name] = at
            at += len(levels) + 1
        return found


def layout_of(statistics: list[PrepStatistics]) -> Layout:
    """Shared columns of several splits of the same features; numbers are scaled as in the first split."""
    first = statistics[0]
    numbers = [n.name for n in first.numbers]
    levels = {
        own.name: sorted({v for s in statistics for v in s.levels[i].levels}) for i, own in enumerate(first.levels)
    }
    center = np.array([n.mean for n in first.numbers])
    return Layout(numbers, center, np.array([n.scale for n in first.numbers]), levels)


def design(layout: Layout, statistics: PrepStatistics) -> np.ndarray:
    """Shared columns to a split's features (in the order of its vector) and, last, its intercept."""
    columns, place = [], {n: i for i, n in enumerate(layout.numbers)}

    def unit(entries):
        column = np.zeros(layout.size)
        for at, value in entries:
            column[at] += value
        columns.append(column)

    missing = 1 + len(layout.numbers)
    for n in statistics.usable_numbers:
        i = place[n.name]
        center, width = layout.center[i], layout.width[i]
        unit([(1 + i, width / n.scale), (0, (center - n.mean) / n.scale), (missing + i, (n.median - center) / n.scale)])
    for n in statistics.numbers:
        if n.had_missing:
            unit([(missing + place[n.name], 1.0 / n.missing_scale), (0, -n.missing_mean / n.missing_scale)])
    starts = layout.starts()
    for c in statistics.levels:
        for level in c.levels:
            entries = [(starts[c.name] + 1 + layout.levels[c.name].index(level), 1.0)]
            unit(entries + ([(starts[c.name], 1.0)] if level == c.fill else []))
    unit([(0, 1.0)])
    return np.array(columns).T


def clips(layout: Layout, statistics: PrepStatistics) -> list[tuple]:
    """(number, low, high) of every clipped number of a split."""
    place = {n: i for i, n in enumerate(layout.numbers)}
    return [(place[n.name], n.low, n.high) for n in statistics.numbers if n.low is not None]


def _columns(layout: Layout):
    """Numbers as doubles, categories as places: 0 missing, 1 .. the levels, -1 a level no split has seen."""
    numbers = [number_or_null(c).cast("double").alias(f"n_{i}") for i, c in enumerate(layout.numbers)]
    places = []
    for i, (name, levels) in enumerate(layout.levels.items()):
        value = F.col(name).cast("string")
        known = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
        found = F.when(value.isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(known, value), F.lit(0)), F.lit(-1)))
        places.append(found.cast("int").alias(f"c_{i}"))
    return [*numbers, *places]


def _laid_out(layout: Layout, batch):
    """The shared columns of a batch and its raw numbers (NaN where missing)."""
    rows, k = batch.num_rows, len(layout.numbers)
    shared = np.zeros((rows, layout.size))
    shared[:, 0] = 1.0
    raw = [batch.column(f"n_{i}").to_numpy(zero_copy_only=False).astype(float, copy=False) for i in range(k)]
    for i, values in enumerate(raw):
        shared[:, 1 + k + i] = np.isnan(values)
        shared[:, 1 + i] = np.where(np.isnan(values), 0.0, (values - layout.center[i]) / layout.width[i])
    for i, start in enumerate(layout.starts().values()):
        at = batch.column(f"c_{i}").to_numpy(zero_copy_only=False)
        known = np.flatnonzero(at >= 0)
        shared[known, start + at[known]] = 1.0
    return shared, raw


def _clip(layout, shared, raw, bounds):
    for i, low, high in bounds:
        kept = (np.clip(raw[i], low, high) - layout.center[i]) / layout.width[i]
        shared[:, 1 + i] = np.where(np.isnan(kept), 0.0, kept)


def logistic_sums(x, target, use, weights):
    """Loss, gradient and second derivatives at ``weights``, one after the other; rows count ``use`` times."""
    margin = x @ weights
    small = np.exp(-np.abs(margin))
    score = np.where(margin >= 0, 1.0, small) / (1.0 + small)
    loss = use @ (np.maximum(margin, 0.0) - target * margin + np.log1p(small))
    gradient = x.T @ (use * (score - target))
    second = (x * (use * score * (1.0 - score))[:, None]).T @ x
    return np.concatenate([[loss], gradient, second[np.triu_indices(x.shape[1])]])


def _summed(rows: DataFrame, add) -> dict[int, np.ndarray]:
    """Sums of ``add(batch, totals)`` over all rows: a split's number to its sums."""

    def partial(batches):
        totals = {}
        for batch in batches:
            add(batch, totals)
        for i, sums in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), i, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                names=["i", "place", "value"],
            )

    parts = rows.mapInArrow(partial, "i int, place int, value double")
    # A few hundred sums for each split, whatever the number of rows.
    found = parts.groupBy("i", "place").agg(F.sum("value").alias("value")).toArrow()
    at, place, value = (found.column(c).to_numpy() for c in ("i", "place", "value"))
    out = {}
    for i in np.unique(at).tolist():
        own = at == i
        out[i] = np.zeros(own.sum())
        out[i][place[own]] = value[own]
    return out


def _unpacked(sums, size):
    second = np.zeros((size, size))
    second[np.triu_indices(size)] = sums[1 + size :]
    return sums[0], sums[1 : 1 + size], second + np.triu(second, 1).T


def _newton(starts: dict, evaluate, most) -> dict:
    """Minimise several convex functions side by side; a step that makes a loss larger is halved.

    ``evaluate`` maps {key: point} to {key: (loss, gradient, second derivatives)} by one pass over the rows.
    """
    points, kept, steps, done = dict(starts), {}, {}, {}
    for _ in range(most):
        if not points:
            break
        found = evaluate(points)
        for key in list(points):
            loss, gradient, second = found[key]
            if not np.isfinite(loss):
                raise ValueError("the linear model needs finite features")
            if key in kept and loss > kept[key][1] + LOSS_NOISE * abs(kept[key][1]):
                steps[key] = steps[key] / 2.0
                points[key] = kept[key][0] - steps[key]
                if np.abs(steps[key]).max() < 1e-12:
                    done[key] = kept[key][0]
                    del points[key]
                continue
            kept[key] = (points[key], loss)
            steps[key] = np.linalg.lstsq(second, gradient, rcond=1e-14)[0]
            points[key] = points[key] - steps[key]
            if gradient @ steps[key] <= LAST_GAIN:
                done[key] = points.pop(key)
    return done | points


def rows_of(base: DataFrame, layout: Layout, splits: list) -> DataFrame:
    """What the passes read: numbers, places of levels, the label ``y``, and marks of the rows that each split is fitted
    on (``u_<i>``) and held out from (``h_<i>``)."""
    marks = []
    for i, s in enumerate(splits):
        marks += [F.coalesce(condition, F.lit(False)).alias(f"{kind}_{i}") for kind, condition in (("u", s.fit), ("h", s.hold))]
    return base.select(*_columns(layout), F.col(S.LABEL).cast("double").alias("y"), *marks)


def _read(rows: DataFrame, kind, points) -> DataFrame:
    """The rows with the marks that a pass needs."""
    marks = {f"{kind}_{i}" for i in points}
    return rows.select(*[c for c in rows.columns if c[:2] not in ("u_", "h_") or c in marks])


def fit_weights(rows: DataFrame, layout: Layout, statistics: list, settings) -> list[np.ndarray]:
    """Coefficients and, last, the intercept of every split, by passes over the rows that serve all splits."""
    designs = [design(layout, s) for s in statistics]
    bounds = [clips(layout, s) for s in statistics]
    penalty = [np.append(np.full(d.shape[1] - 1, 1.0 / settings.inverse_penalty), 0.0) for d in designs]

    def evaluate(points):
        shared_points = {i: designs[i] @ w for i, w in points.items()}

        def add(batch, totals):
            shared, raw = _laid_out(layout, batch)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for i, weights in shared_points.items():
                _clip(layout, shared, raw, bounds[i])
                use = batch.column(f"u_{i}").to_numpy(zero_copy_only=False).astype(float)
                totals[i] = totals.get(i, 0.0) + logistic_sums(shared, y, use, weights)

        found = {}
        for i, sums in _summed(_read(rows, "u", points), add).items():
            loss, gradient, second = _unpacked(sums, layout.size)
            own, w = designs[i], points[i]
            found[i] = (
                loss + 0.5 * (penalty[i] * w) @ w,
                own.T @ gradient + penalty[i] * w,
                own.T @ second @ own + np.diag(penalty[i]),
            )
        return found

    classes = [F.struct(F.count_if(F.col(f"u_{i}") & (F.col("y") == 1)), F.count_if(F.col(f"u_{i}") & (F.col("y") != 1))) for i in range(len(designs))]
    labels = rows.agg(*classes).first()
    fixed, starts = {}, {}
    for i, (positive, negative) in enumerate(labels):
        if not positive and not negative:
            raise ValueError("a split has no rows to fit")
        start = np.zeros(designs[i].shape[1])
        if positive and negative:
            start[-1] = np.log(positive / negative)
            starts[i] = start
        else:  # one class: no coefficient, and a score of 0 or 1
            start[-1] = np.inf if positive else -np.inf
            fixed[i] = start
    found = _newton(starts, evaluate, settings.max_iterations) | fixed
    return [found[i] for i in range(len(designs))]


def _sigmoids(prepared: list, summed) -> list[tuple]:
    """Slope and intercept of each split; ``summed`` maps (points, add) to sums over the rows by the split's number,
    where ``add(totals, i, margins, labels, point)`` adds a split's held-out rows of a batch."""
    targets = [(1.0 / (p.hold_negative + 2.0), (p.hold_positive + 1.0) / (p.hold_positive + 2.0)) for p in prepared]

    def add(totals, i, margins, labels, point):
        x = np.column_stack([margins, np.ones(len(margins))])
        low, high = targets[i]
        target = np.where(labels == 1, high, low)
        totals[i] = totals.get(i, 0.0) + logistic_sums(x, target, np.ones(len(margins)), point)

    def evaluate(points):
        found = {}
        for i, sums in summed(points, add).items():
            loss, gradient, second = _unpacked(sums, 2)
            if second[0, 0] * second[1, 1] - second[0, 1] ** 2 <= 1e-12 * second[0, 0] * second[1, 1]:
                # All margins are equal: no slope.
                gradient = np.array([second[1, 1] * points[i][0], gradient[1] + second[0, 1] * -points[i][0]])
                second = np.diag([second[1, 1], second[1, 1]])
            found[i] = (loss, gradient, second)
        return found

    for p in prepared:
        if not p.hold_positive and not p.hold_negative:
            raise ValueError("a split has no held-out rows")
    found = _newton({i: np.array([1.0, 0.0]) for i in range(len(prepared))}, evaluate, 200)
    return [tuple(map(float, found[i])) for i in range(len(prepared))]


def fit_sigmoids(rows: DataFrame, layout: Layout, prepared: list, statistics: list, weights: list) -> list[tuple]:
    """Slope and intercept of each split's sigmoid on its held-out rows, with the soft targets of ``models.fit_sigmoid``."""
    shared_weights = [design(layout, s) @ w for s, w in zip(statistics, weights)]
    bounds = [clips(layout, s) for s in statistics]

    def summed(points, add):
        def held_out(batch, totals):
            shared, raw = _laid_out(layout, batch)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for i, point in points.items():
                held = np.flatnonzero(batch.column(f"h_{i}").to_numpy(zero_copy_only=False))
                own = shared[held]
                _clip(layout, own, [v[held] for v in raw], bounds[i])
                add(totals, i, own @ shared_weights[i], y[held], point)

        return _summed(_read(rows, "h", points), held_out)

    return _sigmoids(prepared, summed)


def fit_margin_sigmoids(margins: DataFrame, prepared: list) -> list[tuple]:
    """As ``fit_sigmoids``, from a table of any models' held-out margins: split ``i``, margin ``x``, label ``y``."""

    def summed(points, add):
        def held_out(batch, totals):
            which, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "x", "y"))
            for i, point in points.items():
                own = np.flatnonzero(which == i)
                if len(own):
                    add(totals, i, x[own], y[own], point)

        return _summed(margins.where(F.col("i").isin(list(points))), held_out)

    return _sigmoids(prepared, summed)


def as_model(spark, estimator, weights):
    """An ordinary ``LogisticRegressionModel`` with the estimator's columns."""
    vector = _py2java(spark.sparkContext, Vectors.dense(weights[:-1]))
    made = estimator._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", estimator.uid, vector, float(weights[-1])
    )
    return estimator._copyValues(estimator._create_model(made))
