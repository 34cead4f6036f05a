import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide import session
from ebbtide.llm import packing

from .conftest import ODD


def _fits(patterns, histogram, capacity):
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= capacity
        for size, n in pattern.items():
            used[size] += n * times
    assert used == Counter(histogram)
    return sum(times for _, times in patterns)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_all_pieces_are_packed_once(histogram):
    patterns, left, _ = packing.solve_patterns(histogram, capacity=40, rounds=10)
    whole = packing.best_fit(left, patterns, capacity=40)
    _fits(whole, histogram, 40)
    table, n = packing.places_by_rank(whole)
    assert n == sum(t for _, t in whole) and table.tolist() == sorted(table.tolist())


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        sizes = rng.sample(range(2, 30), 5)
        prices = [rng.random() for _ in sizes]
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - s] + p for s, p in zip(sizes, prices) if s <= c])
        pattern = packing.best_patterns(np.array(sizes), np.array(prices), 30, 1)[0]
        worth = dict(zip(sizes, prices))
        assert sum(worth[s] * n for s, n in pattern.items()) == pytest.approx(best[30])


def test_few_sequences_more_than_the_tokens_need():
    rng = np.random.default_rng(4)
    sizes = np.clip(rng.lognormal(6, 1.2, 20_000).astype(int), 1, 4096)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    patterns, left, _ = packing.solve_patterns(histogram)
    assert sum(s * n for s, n in left.items()) < 0.9 * sizes.sum()  # the program places a part worth its name
    n = _fits(packing.best_fit(left, patterns), histogram, 4096)
    assert n <= math.ceil(sizes.sum() / 4096) * 1.002 + 1


def _sequences(packing_of):
    return sum(times for _, times in packing_of)


def _fewest(sizes, capacity):
    """Optimum by trying every place for the next piece, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(3, 24), min_size=1, max_size=9))
def test_small_inputs_near_the_optimum(sizes):
    histogram = Counter(sizes)
    found, fewest = packing.pack_histogram(histogram, capacity=30, rounds=20), _fewest(sizes, 30)
    assert _fits(found, histogram, 30) <= fewest + 1
    assert packing.solve_patterns(histogram, capacity=30, rounds=20)[2] <= fewest


def test_programs_with_a_known_optimum():
    assert _sequences(packing.pack_histogram({1400: 2000, 1296: 1000})) == 1000
    rng, triplets = random.Random(1), Counter()
    for _ in range(300):
        a = rng.randint(1025, 1900)
        b = rng.randint(1025, min(2047, 4096 - a - 1025))
        triplets.update([a, b, 4096 - a - b])
    found = packing.pack_histogram(triplets)
    assert _fits(found, triplets, 4096) <= 312
    assert _sequences(packing.best_fit(triplets, [])) > 330
    assert packing.solve_patterns(triplets)[2] == 300


def test_texts_are_encoded_once(documents):
    plan = packing.pieces(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def _pieces(rows, tokenizer, capacity):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def _gapless(found, capacity):
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity
    return len(at)


def test_whole_table(documents, rows, tokenizer):
    found = packing.packed(documents, capacity=512).collect()
    expected = _pieces(zip(rows["doc_id"], rows["text"]), tokenizer, 512)
    assert sorted(tuple(r)[:5] for r in found) == sorted(expected)
    assert _gapless(found, 512) <= math.ceil(sum(p[3] for p in expected) / 512) * 1.01 + 1


def test_sequences_hold_the_ids(documents, rows, tokenizer):
    placed = packing.packed(documents.where("doc_id < 40"), with_ids=True)
    whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(placed).collect()}
    text = dict(zip(rows["doc_id"], rows["text"]))
    for r in placed.collect():
        ids = [*tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids, 1]
        there = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert there.tolist() == ids[r["start"] : r["start"] + r["length"]]


def test_odd_rows(odd, nothing, tokenizer):
    found = packing.packed(odd).collect()
    key = lambda p: tuple(map(str, p))
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(_pieces([r[:2] for r in ODD], tokenizer, 4096), key=key)
    _gapless(found, 4096)
    assert packing.packed(nothing).count() == 0


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    """Tables whose rows are long are written with small batches, and the session's own size is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = spark.range(0, 3 * session.FEW_ROWS + 7, 1, 1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"
    )
    rows = [r["n"] for r in session.materialized(sizes, "sizes", session.FEW_ROWS).collect()]
    assert sum(rows) == 3 * session.FEW_ROWS + 7 and max(rows) <= session.FEW_ROWS
    assert spark.conf.get(name) == before

    seen = {}

    def noted(df, label, *rows):
        seen[label] = rows
        return session.materialized(df, label, *rows)

    monkeypatch.setattr(packing, "materialized", noted)
    packing.packed(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert seen["pieces"] == (session.FEW_ROWS,)
