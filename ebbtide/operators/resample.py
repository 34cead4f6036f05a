"""Bootstrap intervals of ROC-AUC and seeded column permutation, both spread over the cluster.

Every bootstrap round draws exactly as many rows as the table has. Most of them come as one Poisson weight per
(cell, round), where a cell is a group of rows with equal scores and label, with a mean a little below the
cell's rows. Given their sum such weights are a multinomial draw, so the rows that a round still lacks (about
``MARGIN`` times the root of the table's rows) are added one by one, each a uniform rank among all rows.

Cells are sorted inside fixed pieces of the score axis. Each piece reports, per round, its weighted positives,
negatives and concordant pairs; a running sum over the few pieces then gives the AUC of every round. No task
needs all cells.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.functions.columns import number_or_null, shuffled_order
from ebbtide.operators.ordering import value_edges, with_piece
from ebbtide.session import materialized, small_table

BLOCK = 1024  # cells per weight matrix
LARGE = 64  # rows of a cell above which its draws do not come from a table
MARGIN = 7.0  # standard deviations by which the Poisson weights of a round aim below the table's rows
CHUNK = 100_000  # single rows that one line of the plan for a round asks for


def _poisson_weights(rounds, share, large):
    """A function from cells to one row of Poisson draws each, with the mean ``share`` times the cell's rows.

    Everything it needs is defined inside, so workers can run it without the package being installed there.
    """

    def uniforms(keys):
        """A number in [0, 1) for each key and round, from a counter hash, so that re-run tasks draw the same."""
        x = keys[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53

    def cumulative(mean):
        """Poisson distribution function at 0, 1, 2 ... as far as doubles tell it from 1."""
        last = int(mean + 12 * mean**0.5 + 20)
        steps = np.log(mean) - np.log(np.arange(1, last + 1))
        return np.cumsum(np.exp(-mean + np.r_[0.0, np.cumsum(steps)]))

    def weights(cells, counts):
        """One row of Poisson draws per cell; cells of equal counts are drawn together.

        Counts above LARGE have a generator each: they are few, because each stands for that many rows.
        """
        keys, drawn = cells.astype(np.uint64), np.zeros((len(cells), rounds))
        if share == 0:
            return drawn
        for count in np.unique(counts):
            rows = np.flatnonzero(counts == count)
            mean = float(count) * share
            if count <= large:
                drawn[rows] = np.searchsorted(cumulative(mean), uniforms(keys[rows]), side="right")
            else:
                for r in rows:
                    drawn[r] = np.random.Generator(np.random.Philox(key=int(keys[r]))).poisson(mean, rounds)
        return drawn

    return weights


def _round_sums(rounds, share, block=BLOCK, large=LARGE):
    """A function over batches of cells that adds up the Poisson weights of every round."""
    weights = _poisson_weights(rounds, share, large)

    def run(batches):
        total = np.zeros(rounds)
        for batch in batches:
            for start in range(0, len(batch), block):
                part = batch.iloc[start : start + block]
                total += weights(part["cell"].to_numpy(), part["n"].to_numpy()).sum(axis=0)
        yield pd.DataFrame({"round": np.arange(rounds), "drawn": total.astype(np.int64)})

    return run


def _piece_sums(rounds, share=1.0, redrawn=(), block=BLOCK, large=LARGE):
    """A function over batches of cells sorted by (which, piece, score) that keeps vectors of length ``rounds``.

    ``redrawn`` rounds take single rows alone. Those are in the columns ``extra_rounds`` and ``extra_rows``.
    """
    weights = _poisson_weights(rounds, share, large)

    def with_single_rows(drawn, cells):
        drawn[:, list(redrawn)] = 0
        if "extra_rounds" in cells:
            held = np.flatnonzero(cells["extra_rounds"].notna())
            if len(held):
                which = cells["extra_rounds"].iloc[held]
                rows = np.repeat(held, which.map(len))
                # a round is there once for each cell
                drawn[rows, np.concatenate(which.to_list())] += np.concatenate(cells["extra_rows"].iloc[held].to_list())
        return drawn

    class Piece:
        """Running sums over one piece of the score axis, fed in score order."""

        def __init__(self):
            self.pos, self.neg, self.pairs = np.zeros(rounds), np.zeros(rounds), np.zeros(rounds)
            self.score, self.tied_pos, self.tied_neg = None, np.zeros(rounds), np.zeros(rounds)

        def add(self, cells):
            drawn = with_single_rows(weights(cells["cell"].to_numpy(), cells["n"].to_numpy()), cells)
            positive = cells["y"].to_numpy()[:, None] == 1
            scores = cells["score"].to_numpy()
            starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
            pos = np.add.reduceat(np.where(positive, drawn, 0.0), starts, axis=0)
            neg = np.add.reduceat(np.where(positive, 0.0, drawn), starts, axis=0)
            if self.score == scores[0]:
                pos[0] += self.tied_pos
                neg[0] += self.tied_neg
            elif self.score is not None:
                self.close()
            # the last score may go on in the next block
            self.score, self.tied_pos, self.tied_neg = scores[-1], pos[-1], neg[-1]
            pos, neg = pos[:-1], neg[:-1]
            below = self.neg + np.cumsum(neg, axis=0) - neg
            self.pairs += (pos * (below + neg / 2.0)).sum(axis=0)
            self.pos += pos.sum(axis=0)
            self.neg += neg.sum(axis=0)

        def close(self):
            self.pairs += self.tied_pos * (self.neg + self.tied_neg / 2.0)
            self.pos += self.tied_pos
            self.neg += self.tied_neg
            self.score, self.tied_pos, self.tied_neg = None, np.zeros(rounds), np.zeros(rounds)

        def frame(self, which, piece):
            self.close()
            return pd.DataFrame(
                {
                    "which": which,
                    "piece": piece,
                    "round": np.arange(rounds),
                    "pos": self.pos,
                    "neg": self.neg,
                    "pairs": self.pairs,
                }
            )

    def run(batches):
        open_key, piece = None, None
        for batch in batches:
            for key, part in batch.groupby(["which", "piece"], sort=False):
                if key != open_key:
                    if piece is not None:
                        yield piece.frame(*open_key)
                    open_key, piece = key, Piece()
                for start in range(0, len(part), block):
                    piece.add(part.iloc[start : start + block])
        if piece is not None:
            yield piece.frame(*open_key)

    return run


def _lacking_rows(cells: DataFrame, n, rounds, share):
    """Rows that each round still lacks after its Poisson weights, and the rounds that drew too many.

    The latter (about one in 10^12) are drawn anew, row by row; the driver gets one number for each round.
    """
    sums = cells.select("cell", "n").mapInPandas(_round_sums(rounds, share), "round int, drawn bigint")
    drawn = {r["round"]: r["drawn"] for r in sums.groupBy("round").agg(F.sum("drawn").alias("drawn")).collect()}
    redrawn = [r for r in range(rounds) if drawn.get(r, 0) > n]
    return {r: n if r in redrawn else n - drawn.get(r, 0) for r in range(rounds)}, redrawn


def _single_rows(cells: DataFrame, keys, n, lacking, seed) -> DataFrame:
    """Cells with the rounds that draw single rows of them: ``(keys..., extra_rounds, extra_rows)``.

    Rows are numbered in the order of their cells' hashes, inside equal slices of its range. A drawn number finds
    its cell as the last one that starts at or below it, inside equal pieces of the numbers.
    """
    spark = cells.sparkSession
    slices = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = cells.withColumn(
        "_slice", F.floor((F.col("cell").cast("double") + 2.0**63) / (2.0**64 / slices)).cast("int")
    )
    inside = Window.partitionBy("_slice").orderBy("cell", *keys).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each slice
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("_slice").agg(F.sum("n").alias("_n")).select(
        "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    begin = F.coalesce(F.sum("n").over(inside), F.lit(0))
    numbered = sliced.withColumn("_begin", begin).join(offsets, "_slice").withColumn(
        "at", F.col("_begin") + F.col("_offset")
    )
    width = -(-n // slices)
    piece = lambda c: F.floor(c / F.lit(width)).cast("int")
    owner = F.struct(*keys)
    starts = numbered.select(
        F.explode(F.sequence(piece(F.col("at")), piece(F.col("at") + F.col("n") - 1))).alias("piece"),
        "at", F.lit(-1).alias("round"), owner.alias("owner"),
    )
    lines = [
        (r, first, min(first + CHUNK, rows) - 1) for r, rows in lacking.items() for first in range(0, rows, CHUNK)
    ]
    plan = small_table(spark, lines, "round int, first bigint, last bigint").repartition(slices, "round", "first")
    draws = plan.select("round", F.explode(F.sequence("first", "last")).alias("draw"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), F.lit("row"), "round", "draw"), 11) * F.lit(2.0**-53)
    draws = draws.select("round", F.least(F.floor(uniform * n), F.lit(n - 1)).cast("long").alias("at"))
    drawn = draws.select(piece(F.col("at")).alias("piece"), "at", "round")
    upto = Window.partitionBy("piece").orderBy("at", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        starts.unionByName(drawn, allowMissingColumns=True)
        .withColumn("owner", F.last("owner", ignorenulls=True).over(upto))
        .filter(F.col("round") >= 0)
    )
    counted = found.groupBy("owner", "round").agg(F.count("*").cast("int").alias("rows"))
    # at most one entry for each round
    extra = counted.groupBy("owner").agg(F.collect_list(F.struct("round", "rows")).alias("extra"))
    return extra.select(
        "owner.*",
        F.transform("extra", lambda e: e["round"]).alias("extra_rounds"),
        F.transform("extra", lambda e: e["rows"]).alias("extra_rows"),
    )


def bootstrap_aucs(df: DataFrame, scores, label=S.LABEL, rounds=S.BOOTSTRAP_ROUNDS, seed=S.SEED,
                   pieces=None) -> DataFrame:
    """AUC of each score column in each round, from the same draws: ``(which, round, auc, n_rows)``.

    A round draws ``n_rows`` rows with replacement, always as many as have a label and all scores. Rounds that
    drew only one class have no AUC and are left out.
    """
    scores, rounds = list(scores), int(rounds)
    usable = df.select(*[number_or_null(s).alias(s) for s in scores], F.col(label).cast("int").alias("y"))
    usable = usable.dropna()
    keys = [*scores, "y"]
    grouped = usable.groupBy(*keys).agg(F.count("*").alias("n"))
    cells = materialized(grouped.withColumn("cell", F.xxhash64(F.lit(int(seed)), *keys)), "bootstrap-cells")
    n = cells.agg(F.sum("n")).first()[0] or 0
    share = max(0.0, n - MARGIN * math.sqrt(n)) / max(n, 1)
    lacking, redrawn = _lacking_rows(cells, n, rounds, share)
    if any(lacking.values()):
        cells = cells.join(_single_rows(cells, keys, n, lacking, seed), keys, "left")
    else:
        none = F.lit(None).cast("array<int>")
        cells = cells.withColumns({"extra_rounds": none, "extra_rows": none})
    entries = [F.struct(F.lit(i).alias("which"), F.col(s).alias("score")) for i, s in enumerate(scores)]
    long = cells.select("cell", "y", "n", "extra_rounds", "extra_rows", F.inline(F.array(*entries)))
    edges = value_edges(
        usable.select(F.explode(F.array(*scores)).alias("score")), "score", pieces=pieces
    )
    split = with_piece(long, "score", edges, "piece")
    sums = (
        split.repartition((len(edges) + 1) * len(scores), "which", "piece")
        .sortWithinPartitions("which", "piece", "score")
        .mapInPandas(
            _piece_sums(rounds, share, redrawn),
            "which int, piece int, round int, pos double, neg double, pairs double",
        )
    )
    before = (
        Window.partitionBy("which", "round").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sums.withColumn("_below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    return (
        joined.groupBy("which", "round")
        .agg(
            F.try_divide(
                F.sum(F.col("pairs") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg")
            ).alias("auc"),
            F.sum(F.col("pos") + F.col("neg")).cast("long").alias("n_rows"),
        )
        .filter(F.col("auc").isNotNull())
        .withColumn("which", F.element_at(F.array(*[F.lit(s) for s in scores]), F.col("which") + 1))
    )


def auc_interval(df: DataFrame, score, label=S.LABEL, rounds=S.BOOTSTRAP_ROUNDS, seed=S.SEED, alpha=0.05,
                 pieces=None) -> DataFrame:
    """Percentile interval of the AUC and the number of rounds kept."""
    draws = bootstrap_aucs(df, [score], label, rounds, seed, pieces)
    # at most ``rounds`` values
    return draws.agg(
        F.percentile("auc", alpha / 2).alias("auc_lo"),
        F.percentile("auc", 1 - alpha / 2).alias("auc_hi"),
        F.count("*").alias("n_rounds"),
    )


def auc_difference_interval(df: DataFrame, score_a, score_b, label=S.LABEL, rounds=S.BOOTSTRAP_ROUNDS,
                            seed=S.SEED, alpha=0.05, pieces=None) -> DataFrame:
    """Paired interval of AUC(a) - AUC(b): both scores are weighted by the same draws."""
    if score_a == score_b:
        df, score_b = df.withColumn("_same", F.col(score_a)), "_same"
    draws = bootstrap_aucs(df, [score_a, score_b], label, rounds, seed, pieces)
    gaps = draws.groupBy("round").agg(
        (
            F.max(F.when(F.col("which") == score_a, F.col("auc")))
            - F.max(F.when(F.col("which") == score_b, F.col("auc")))
        ).alias("gap")
    )
    return gaps.agg(
        F.avg("gap").alias("diff_mean"),
        F.percentile("gap", alpha / 2).alias("diff_lo"),
        F.percentile("gap", 1 - alpha / 2).alias("diff_hi"),
        F.count("gap").alias("n_rounds"),
    )


def _places(df: DataFrame, order, keys, name, slices) -> DataFrame:
    """Dense row places 0..n-1 per key in hash order.

    A hash spreads evenly, so equal slices of its range hold nearly equal numbers of rows; places are counted
    inside a slice and shifted by the sizes of the slices before it.
    """
    width = (1 << 64) // slices
    sliced = df.withColumn("_order", order).withColumn(
        "_slice", F.floor((F.col("_order").cast("double") + float(1 << 63)) / float(width)).cast("int")
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_order", *_tie(df)))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        sliced.withColumn("_within", within)
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_offset") + F.col("_within") - 1)
        .drop("_order", "_slice", "_within", "_offset")
    )


def _tie(df):
    return [S.ID] if S.ID in df.columns else []


def permuted_pairs(df: DataFrame, columns, repeats, seed=S.SEED, slices=None) -> DataFrame:
    """Each row beside the ``columns`` of a randomly chosen other row, once per repeat.

    Within a repeat every row is the donor of exactly one row. Donor values are in ``donor_<column>``.
    """
    if slices is None:
        slices = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    base = _places(df, shuffled_order(S.ID, seed), [], "_place", slices)
    donors = df.select(S.ID, *[F.col(c).alias(f"donor_{c}") for c in columns], repeat)
    donor_order = F.xxhash64(F.lit(int(seed)), F.col("repeat") + 1, F.col(S.ID).cast("string"))
    donors = _places(donors, donor_order, ["repeat"], "_place", slices).drop(S.ID)
    return base.join(donors, "_place").drop("_place")


def permute_column(df: DataFrame, column, seed=S.SEED) -> DataFrame:
    """The table with one column's values dealt out to other rows at random."""
    pairs = permuted_pairs(df, [column], 1, seed)
    return pairs.withColumn(column, F.col(f"donor_{column}")).select(df.columns)
