import re

import pytest

from ebbtide.llm import mixing

from .conftest import ODD


def _targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess again and again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in full}
        full |= over


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 10, None: 5},
        {"a": 3, "b": 2, "c": 5000, "d": 1, "e": 1},
        {"a": 0, "b": 7},
        {"Z": 10, "a": 20, "é": 5, "\U0001f600": 9, "￮": 9, None: 4},
        {"a": 9},
    ],
)
def test_targets_equal_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert found == {s: pytest.approx(t) for s, t in _targets(sizes).items()}


def test_whole_table(documents, rows):
    found = mixing.mixed(documents).collect()
    again = {r["doc_id"]: r["n_copies"] for r in mixing.mixed(documents.repartition(5, "text")).collect()}
    size = {d: _size(t) for d, t in zip(rows["doc_id"], rows["text"])}
    sizes = {}
    for d, s in zip(rows["doc_id"], rows["source"]):
        sizes[s] = sizes.get(s, 0) + size[d]
    targets = _targets(sizes)
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert int(r["rate"]) <= r["n_copies"] <= min(3, int(r["rate"]) + 1)
        assert r["n_copies"] == again[r["doc_id"]]
    taken, total = sum(r["size"] * r["n_copies"] for r in found), sum(size.values())
    assert abs(taken - total) < 0.15 * total


def test_expected_copies_equal_the_rate(spark):
    frame = spark.range(20_000).selectExpr("id", "1.3D as rate")
    mean = frame.select(mixing.copies(frame["rate"], 42, frame["id"]).alias("n")).groupBy().avg("n").head()[0]
    assert abs(mean - 1.3) < 0.02


def test_emitted_rows_follow_the_counts(odd, nothing):
    counts = {}
    for r in mixing.mixed(odd).collect():
        counts.setdefault((r["doc_id"], r["row_hash"]), []).append(r["n_copies"])
    assert all(len(set(n)) == 1 for n in counts.values())
    emitted = mixing.emit(odd)
    assert emitted.columns == odd.columns
    assert emitted.count() == sum(map(sum, counts.values()))
    assert mixing.mixed(odd).count() == len(ODD)
    assert mixing.mixed(nothing).count() == 0 and mixing.emit(nothing).count() == 0
