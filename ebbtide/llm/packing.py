"""Packing documents into training sequences by a configuration linear program over the length histogram.

The program has a variable for each pattern (a multiset of lengths that fits a sequence) and asks for the fewest
sequences that hold all pieces. Multiplicative weights put a price on every length, a knapsack by dynamic programming
finds the patterns worth most at these prices, and lengths that are covered slower than others get dearer; the prices
also bound the program's optimum from below. The fractional solution is rounded down, the rest is solved again while
that gives whole sequences, and what is left over is packed best fit, longest first (or everything is, where that takes
fewer sequences). All of that works on the histogram, which has at most as many rows as a sequence has tokens, however
many documents there are. Documents find their places by their rank within their length.
"""

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.text import vocabulary, whole_text, word_encoder
from ebbtide.session import FEW_ROWS, materialized

SEQUENCE = 4096
END_ID = 1
#: Prices that are tried for the program, and for each program of what rounding leaves over.
ROUNDS, ROUNDS_AGAIN = 120, 12
PATTERNS_PER_ROUND = 8
#: Patterns of a round that are taken are worth this share of its best one.
NEARLY_BEST = 0.998
#: How fast a length gets dearer that lags behind.
RATE = 0.05
#: Coverage beyond this many times the even pace counts as this many.
CLIP = 20
#: Pieces whose ranks within a length one task counts, on average.
RANKED_ROWS = 20_000


def best_patterns(lengths, prices, capacity, n_best):
    """Patterns (length to times) of most worth for the last ``n_best`` fill levels, by unbounded knapsack."""
    worth = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, values = lengths[order], prices[order]
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fitting[c]
        best, via = worth[c - 1], -1
        if k:
            candidates = worth[c - sizes[:k]] + values[:k]
            i = int(candidates.argmax())
            if candidates[i] > best:
                best, via = candidates[i], i
        worth[c], choice[c] = best, via
    found = []
    for c in range(capacity, max(capacity - n_best, 0), -1):
        pattern, left = {}, c
        while left > 0:
            via = choice[left]
            if via < 0:
                left -= 1
            else:
                size = int(sizes[via])
                pattern[size] = pattern.get(size, 0) + 1
                left -= size
        if pattern and pattern not in found:
            found.append(pattern)
    return found


def fractional_patterns(lengths, total, capacity=SEQUENCE, rounds=ROUNDS):
    """(pattern to the sequences it fills, a lower bound on the sequences any packing needs).

    Each round's prices give patterns; those worth nearly as much as the best one take an even share of the sequences
    that the tokens need. Prices times pieces over the best pattern's worth is a bound by duality.
    """
    place = {int(x): i for i, x in enumerate(lengths)}
    covered, weight, filled = np.zeros(len(lengths)), np.ones(len(lengths)), {}
    tokens = float((lengths * total).sum())
    bound = math.ceil(tokens / capacity - 1e-9)
    for step in range(1, rounds + 1):
        prices = lengths / capacity * weight
        found = best_patterns(lengths, prices, capacity, PATTERNS_PER_ROUND)
        worth = [sum(prices[place[size]] * n for size, n in pattern.items()) for pattern in found]
        best = max(worth)
        bound = max(bound, math.ceil(float((prices * total).sum()) / best - 1e-6))
        taken = [p for p, w in zip(found, worth) if w >= NEARLY_BEST * best]
        for pattern in taken:
            key, share = tuple(sorted(pattern.items())), tokens / capacity / rounds / len(taken)
            filled[key] = filled.get(key, 0.0) + share
            for size, n in pattern.items():
                covered[place[size]] += n * share
        # A rare length may be covered many times over by one pattern; that must not drive up all the others.
        lag = np.minimum(covered / total, CLIP * step / rounds)
        weight *= np.exp(RATE * (lag.mean() - lag))
    return {key: x for key, x in filled.items() if x > 0}, bound


def solve_patterns(histogram, capacity=SEQUENCE, rounds=ROUNDS):
    """(patterns with the whole number of sequences each fills, what is left of the histogram, lower bound).

    Fractions are rounded down, the fullest patterns first; the program of the rest is solved until it rounds to
    nothing.
    """
    left, used, bound = dict(histogram), [], 0
    while len(left) > 1:
        lengths = np.array(sorted(left), np.int64)
        total = np.array([left[int(x)] for x in lengths], np.float64)
        filled, least = fractional_patterns(lengths, total, capacity, rounds if not used and not bound else ROUNDS_AGAIN)
        bound = bound or least
        taken = 0
        for key, x in sorted(filled.items(), key=lambda e: (-sum(s * n for s, n in e[0]), -e[1], e[0])):
            times = min([int(x + 1e-9)] + [left.get(size, 0) // n for size, n in key])
            if times:
                for size, n in key:
                    left[size] -= n * times
                used.append((dict(key), times))
                taken += times
        left = {size: n for size, n in left.items() if n}
        if 100 * capacity * taken < sum(size * n for size, n in left.items()):  # what is left rounds to next to nothing
            break
    tokens = sum(size * n for size, n in histogram.items())
    return used, left, max(bound, -(-tokens // capacity))


def pack_histogram(histogram, capacity=SEQUENCE, rounds=ROUNDS):
    """Patterns with the number of sequences each fills, for the whole histogram: rounded program or best fit alone."""
    used, left, _ = solve_patterns(histogram, capacity, rounds)
    return min(
        best_fit(left, used, capacity),
        best_fit(histogram, [], capacity),
        key=lambda packing: sum(times for _, times in packing),
    )


def best_fit(histogram, patterns, capacity=SEQUENCE):
    """Patterns after the rest of the histogram is packed into them or new sequences: best fit, longest first.

    Sequences with equal contents are handled together, so the work follows the number of lengths and patterns.
    """
    open_groups, rooms = {}, []

    def add(room, pattern, times):
        if room not in open_groups:
            open_groups[room] = []
            insort(rooms, room)
        open_groups[room].append((pattern, times))

    for pattern, times in patterns:
        add(capacity - sum(s * n for s, n in pattern.items()), pattern, times)
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                if n >= per:
                    add(capacity - per * size, {size: per}, n // per)
                if n % per:
                    add(capacity - n % per * size, {size: n % per}, 1)
                break
            room = rooms[at]
            pattern, times = open_groups[room].pop()
            if not open_groups[room]:
                del open_groups[room]
                rooms.pop(at)
            filled = min(times, n)
            if filled < times:
                add(room, pattern, times - filled)
            add(room - size, {**pattern, size: pattern.get(size, 0) + 1}, filled)
            n -= filled
    return [group for room in rooms for group in open_groups[room]]


def places_by_rank(patterns):
    """Table that tells where the pieces of each length go, by rank: sorted by (length, first rank).

    Columns: length, first rank, pieces of that length in a sequence, first sequence, offset of the first of them.
    """
    ranks, rows, sequence = {}, [], 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            rows.append((size, ranks.get(size, 0), n, sequence, offset))
            ranks[size] = ranks.get(size, 0) + n * times
            offset += n * size
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), sequence


def pieces(docs: DataFrame, path=None, end_id=END_ID, capacity=SEQUENCE, with_ids=False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, bytes): every text's ids and end_id, cut at capacity.

    A null text is empty and gives one piece, the end id.
    """
    path = path or vocabulary("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    fields = "piece:int,start:long,length:long,ids_crc32:long" + (",ids:binary" if with_ids else "")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(texts: pa.Array) -> pa.Array:
        first, piece, start, length, crc, kept = [0], [], [], [], [], []
        for _, ids, ends in word_encoder(path).encode_all(texts):
            raw = ids.astype("<u4").tobytes()
            at = 0
            for stop in ends.tolist():
                whole = raw[4 * at : 4 * stop] + end
                n = stop - at + 1
                for k, begin in enumerate(range(0, n, capacity)):
                    part = whole[4 * begin : 4 * (begin + capacity)]
                    piece.append(k)
                    start.append(begin)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
                first.append(len(piece))
                at = stop
        columns = {"piece": (piece, pa.int32()), "start": (start, pa.int64()), "length": (length, pa.int64())}
        columns |= {"ids_crc32": (crc, pa.int64())} | ({"ids": (kept, pa.binary())} if with_ids else {})
        rows = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)

    return docs.select(F.col("doc_id"), cut(whole_text()).alias("cut")).select(
        # Outer: every text has a piece, and a test for that would run the tokenizer twice.
        "doc_id",
        F.inline_outer("cut"),
    )


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with the rank of every piece within its length, from 0.

    Pieces of one length are counted in buckets by a hash of the row, then buckets before each other, so a length that
    a third of the pieces share is spread over many tasks. Rows that agree in everything are interchangeable.
    """
    least = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(least, cut.count() // RANKED_ROWS)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(n_buckets)).cast("int"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy(*key)
    return (
        bucketed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("bucket", "nth", "before")
    )


def packed(docs: DataFrame, path=None, end_id=END_ID, capacity=SEQUENCE, rounds=ROUNDS, with_ids=False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) for every piece of ``docs``.

    Reads ``doc_id, text``; other columns may have any name. Every row is packed, repeated rows each for itself; doc_id
    may be null. Texts longer than a sequence are cut into full pieces and a rest; a null or empty text is its end id.
    Pieces lie in their sequences without gaps. An empty table gives no rows.
    """
    cut = materialized(pieces(docs, path, end_id, capacity, with_ids), "pieces", FEW_ROWS)
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, _ = places_by_rank(pack_histogram(histogram, capacity, rounds))
    keys = table[:, 0] << 40 | table[:, 1] if len(table) else np.empty(0, np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        return pd.DataFrame(
            {"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * length}
        )

    placed = ranked(cut).withColumn("place", place("length", "rank"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "place.sequence_id",
        "place.offset",
        *(["ids"] if with_ids else []),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences themselves; a sequence is at most ``capacity`` tokens long."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.expr(
            "aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), "
            "cast('' as binary), (a, b) -> concat(a, b))"
        ).alias("ids"),
    )
