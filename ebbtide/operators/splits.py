"""Stratified hold-out and folds by rank cuts on a stable order.

Exact class shares need the order values at a few ranks per class, not the rank of every row. Those values
are found in two scans; the split itself is then a narrow expression, without a window or a shuffle.

Rows of equal order values around a cut are told apart by further hashes of their ids, so shares stay exact when
hashes collide or a given order has ties. A cut is then a tuple: the order value and the hashes at the rank.
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import shuffled_order
from ebbtide.operators.contracts import ContractError
from ebbtide.operators.ordering import rank_cuts

#: Groups and classes a split may have: one small row each comes to the driver.
MAX_CLASSES = 10_000


def holdout_quotas(sizes: dict, share=S.HOLDOUT_SHARE) -> dict:
    """Hold-out rows per class: the total is rounded up, remainders go to the largest fractions."""
    total = sum(sizes.values())
    wanted = -int(-(total * share) // 1)
    exact = {c: wanted * n / total for c, n in sizes.items()}
    quotas = {c: int(x) for c, x in exact.items()}
    left = wanted - sum(quotas.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - int(exact[c])), c))[:left]:
        quotas[c] += 1
    return quotas


def fold_starts(sizes: dict, folds) -> dict:
    """First rank of folds 1..k-1 in each class, so that fold sizes differ by at most one overall.

    Class by class the rows are dealt round-robin to the folds, continuing where the class before stopped;
    within a class each fold then takes one consecutive stretch of the order.
    """
    starts, begin = {}, 0
    for c in sorted(sizes):
        end = begin + sizes[c]
        shares = [-((i - end) // folds) + ((i - begin) // folds) for i in range(folds)]
        starts[c] = [sum(shares[: i + 1]) for i in range(folds - 1)]
        begin = end
    return starts


def stable_order() -> Column:
    """An order that does not depend on a seed, for unshuffled folds of tables with text ids."""
    return F.xxhash64(F.col(S.ID).cast("string"))


#: Hashes of the id that are tried one after the other on rows of equal order values.
TIE_LEVELS = 3


def _tie(level) -> Column:
    return F.xxhash64(F.lit(f"tie {level}"), F.col(S.ID).cast("string"))


def _at_or_above(order: Column, cut, level=0) -> Column:
    """Whether a row lies at or above a cut, in the order of (value, first tie hash, second ...)."""
    if not isinstance(cut, tuple):
        return order >= F.lit(cut)
    rest = cut[1:] if len(cut) > 2 else cut[1]
    return (order > F.lit(cut[0])) | ((order == F.lit(cut[0])) & _at_or_above(_tie(level + 1), rest, level + 1))


def _place(order: Column, cuts: list) -> Column:
    """How many cuts are at or below the row."""
    place = F.lit(0)
    for cut in cuts:
        if cut is not None:
            place = place + F.when(_at_or_above(order, cut), 1).otherwise(0)
    return place


def _of_key(by, key) -> Column:
    return reduce(and_, [F.col(b).eqNullSafe(F.lit(k)) for b, k in zip(by, key)])


def _with_ties_cut(df, order, by, cuts, wanted, level=1):
    """Cuts that leave exactly the wanted number of rows below them, also among rows of equal order values.

    One grouped count tells which cuts fall inside such rows; without any, nothing else runs. Rows that share an id
    as well cannot be told apart and stay together.
    """
    if S.ID not in df.columns or level > TIE_LEVELS or not any(v is not None for vs in cuts.values() for v in vs):
        return cuts
    place = None
    for key, values in cuts.items():
        test, value = _of_key(by, key), _place(order, values)
        place = F.when(test, value) if place is None else place.when(test, value)
    below = {}
    for row in df.filter(order.isNotNull()).groupBy(*by, place.alias("_at")).count().collect():
        below.setdefault(tuple(row[b] for b in by), {})[row["_at"]] = row["count"]
    inside = {}  # (key, cut value) to the rows of this value that belong below, for each cut of this value
    for key, values in cuts.items():
        for value, rank in zip(values, wanted[key]):
            if value is not None:
                smaller = sum(n for at, n in below[key].items() if at <= values.index(value))
                if rank > smaller:
                    inside.setdefault((*key, value), set()).add(rank - smaller)
    if not inside:
        return cuts
    keys = [*by, f"_cut{level}"]
    tied = df.withColumn(keys[-1], order).filter(reduce(or_, [_of_key(keys, k) for k in inside]))
    sizes = {tuple(r[k] for k in keys): r["count"] for r in tied.groupBy(*keys).count().collect()}
    ranks = {key: sorted(found) for key, found in inside.items()}
    finer = _with_ties_cut(tied, _tie(level), keys, rank_cuts(tied, _tie(level), keys, ranks, sizes), ranks, level + 1)
    settled = {}
    for key, values in cuts.items():
        settled[key] = []
        for value, rank in zip(values, wanted[key]):
            found = finer.get((*key, value))
            if value is None or found is None:
                settled[key].append(value)
                continue
            smaller = sum(n for at, n in below[key].items() if at <= values.index(value))
            if rank == smaller:
                settled[key].append(value)
            else:
                cut = found[ranks[(*key, value)].index(rank - smaller)]
                settled[key].append((value, *cut) if isinstance(cut, tuple) else (value, cut))
    return settled


def _by_class(df, order, label, starts_of, group=None):
    """Rank cuts per (group, class); the sizes of all classes are needed before the ranks.

    Rows without a label belong to no class; they would silently drop out of every split, so they are an error.
    """
    by = ([group] if group else []) + [label]
    sizes, classes = {}, {}
    counted = df.filter(order.isNotNull()).groupBy(*by).count().limit(MAX_CLASSES + 1).collect()
    if len(counted) > MAX_CLASSES:
        raise ContractError(f"{label} has too many values for a stratified split")
    unlabelled = max((row["count"] for row in counted if row[label] is None), default=0)
    if unlabelled:
        raise ContractError(f"{unlabelled} rows have no {label}; drop or label them before splitting")
    for row in counted:
        key = tuple(row[b] for b in by)
        sizes[key] = row["count"]
        classes.setdefault(key[:-1], {})[key[-1]] = row["count"]
    wanted = {g: starts_of(c) for g, c in classes.items()}
    ranks = {key: wanted[key[:-1]][key[-1]] for key in sizes}
    return _with_ties_cut(df, order, by, rank_cuts(df, order, by, ranks, sizes), ranks)


def with_holdout(df: DataFrame, share=S.HOLDOUT_SHARE, seed=S.SEED, order=None, label=S.LABEL,
                 name="is_holdout") -> DataFrame:
    """Add the hold-out mark with exact class shares; ``order`` must be a numeric column or expression."""
    order = _order(order, seed)
    cuts = _by_class(
        df, order, label, lambda sizes: {c: [q] for c, q in holdout_quotas(sizes, share).items()}
    )
    mark = None
    for (c,), values in cuts.items():
        test = F.col(label) == c
        inside = ~_at_or_above(order, values[0]) if values[0] is not None else F.lit(True)
        mark = F.when(test, inside) if mark is None else mark.when(test, inside)
    return df.withColumn(name, mark)


def _id_and(df, label):
    """The label, and the id where there is one: it is read only where order values are equal at a cut."""
    return [F.col(c) for c in dict.fromkeys([S.ID, label]) if c in df.columns]


def _order(order, seed):
    if order is None:
        return shuffled_order(S.ID, seed)
    return F.col(order) if isinstance(order, str) else order


def fold_expression(cuts: dict, order: Column, label=S.LABEL, group=None) -> Column:
    """The fold number of a row from the cuts of one group."""
    fold = None
    for key, values in cuts.items():
        if group is not None and key[0] != group:
            continue
        test = F.col(label) == key[-1]
        place = _place(order, values)
        fold = F.when(test, place) if fold is None else fold.when(test, place)
    return fold


def with_fold_schemes(df: DataFrame, schemes: dict, folds=S.FOLDS, label=S.LABEL) -> DataFrame:
    """One stratified fold column per scheme (column name -> order expression); all share the same scans."""
    names = list(schemes)
    orders = [schemes[n] for n in names]
    long = df.select(*_id_and(df, label), F.posexplode(F.array(*orders)).alias("_scheme", "_order"))
    cuts = _by_class(long, F.col("_order"), label, lambda sizes: fold_starts(sizes, folds), "_scheme")
    return df.withColumns({n: fold_expression(cuts, orders[i], label, i) for i, n in enumerate(names)})


def with_folds(df: DataFrame, folds=S.FOLDS, seed=S.SEED, order=None, label=S.LABEL, name="fold") -> DataFrame:
    """Stratified folds; shuffled by seed, or in the given numeric order for unshuffled folds."""
    return with_fold_schemes(df, {name: _order(order, seed)}, folds, label)


def repeat_orders(repeats=S.REPEATS, seed=S.SEED, prefix="fold_") -> dict:
    """A differently shuffled order per repeat."""
    return {f"{prefix}{r}": shuffled_order(S.ID, seed + 1000 * (r + 1)) for r in range(repeats)}


def with_repeated_folds(df: DataFrame, folds=S.FOLDS, repeats=S.REPEATS, seed=S.SEED, label=S.LABEL,
                        prefix="fold_") -> DataFrame:
    """One fold column per repeat, each with its own shuffle."""
    return with_fold_schemes(df, repeat_orders(repeats, seed, prefix), folds, label)


def with_inner_folds(df: DataFrame, outer, outer_folds, folds=S.FOLDS, order=None, label=S.LABEL,
                     prefix="inner_") -> DataFrame:
    """For each outer fold, stratified folds of the rows outside it, all found together.

    The order must be numeric; text ids use an unseeded hash, because only a stable order is needed.
    """
    order = stable_order() if order is None else _order(order, 0)
    others = F.array_remove(F.sequence(F.lit(0), F.lit(outer_folds - 1)), F.col(outer))
    long = df.select(*_id_and(df, label), order.alias("_order"), F.explode(others).alias("_left_out"))
    cuts = _by_class(long, F.col("_order"), label, lambda sizes: fold_starts(sizes, folds), "_left_out")
    return df.withColumns(
        {
            f"{prefix}{o}": F.when(F.col(outer) != o, fold_expression(cuts, order, label, o))
            for o in range(outer_folds)
        }
    )


def smoke_sample(df: DataFrame, rows=S.SMOKE_ROWS, seed=S.SEED) -> DataFrame:
    """A fixed-size seeded sample for a quick trial run; the same rows every time."""
    return df.orderBy(shuffled_order(S.ID, seed), S.ID).limit(rows)
