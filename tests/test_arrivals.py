from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.streaming import incremental as I


@pytest.fixture
def arrive(spark, tmp_path):
    """Let a table arrive as one more file of a stream, run to its end, and return all rows decided so far."""

    def step(rows, remember_days=30):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        checked = I.unique_stream(stream, remember_days)
        I.write_available(checked, tmp_path / "out", tmp_path / "progress").awaitTermination()
        return spark.read.schema(checked.schema).parquet(str(tmp_path / "out")).collect()

    return step


def passed(rows):
    return Counter(r[S.ID] for r in rows if not r["violations"])


def test_a_repeated_id_passes_once_across_restarts(customers, arrive):
    first = customers({"customer_id": "a"}, {"customer_id": "b"}, {"customer_id": "a", "monthly_spend": 1.5})
    out = arrive(first)
    assert passed(out) == {"a": 1, "b": 1}
    assert [r["violations"] for r in out if r["violations"]] == [[I.REPEATED]]
    out = arrive(customers({"customer_id": "b"}, {"customer_id": "c"}))  # a new query goes on from the stored state
    assert passed(out) == {"a": 1, "b": 1, "c": 1} and len(out) == 5
    assert Counter(r[S.ID] for r in out if r["violations"] == [I.REPEATED]) == {"a": 1, "b": 1}


def test_a_row_that_breaks_a_rule_does_not_claim_its_id(customers, arrive):
    out = arrive(customers({"customer_id": "a", "region": None}))
    assert [r["violations"] for r in out] == [["region is missing"]]
    out = arrive(customers({"customer_id": "a"}, {"customer_id": "a", "region": None}))
    assert passed(out) == {"a": 1}
    assert Counter(tuple(r["violations"]) for r in out if r["violations"]) == {("region is missing",): 2}


def test_rows_without_an_id_stay_violations_and_never_repeat(customers, arrive):
    out = arrive(customers(*[{"customer_id": None}] * 3))
    assert [r["violations"] for r in out] == [[f"{S.ID} is missing"]] * 3


def test_values_and_types_survive(spark, customers, arrive):
    rows = customers(
        {"customer_id": "a", "monthly_spend": 0.1 + 0.2, "churned": None},
        {"customer_id": "b", "monthly_spend": float("nan"), "avg_order_value": None},
    ).withColumns(
        {
            "large": F.lit(2**53 + 1), "none": F.lit(None).cast("long"), "at": F.lit("2024-05-06 07:08:09.123456").cast("timestamp"),
            "list": F.array(F.lit(1), F.lit(None).cast("int")), "bytes": F.lit(b"\x00\xff"), "violation_count": F.lit("x"),
        }
    )
    got = {r[S.ID]: r for r in arrive(rows)}
    for row in rows.collect():
        for c in rows.columns:
            assert repr(got[row[S.ID]][c]) == repr(row[c]), c


def test_stream_equals_batch(population, arrive):
    number = F.substring(S.ID, 3, 4).cast("int")
    for part in (number % 3 != 0, number % 2 == 0, number >= 0):
        out = arrive(population.filter(part))
    valid = {r[S.ID] for r in I.checked_stream(population).filter(F.size("violations") == 0).collect()}
    assert passed(out) == Counter(valid)
    assert len(out) == 160 + 120 + 240


class State:
    """A stand-in for one key's state."""

    def __init__(self, watermark=0):
        self.value, self.watermark, self.until, self.hasTimedOut = None, watermark, None, False

    @property
    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, until):
        self.until = until


def test_one_row_is_held_whatever_the_batches():
    import pandas as pd

    rows = pd.DataFrame(
        {"x": list("abcdef"), "_valid": [True, False, True, True, False, True], "_order": [5, 1, 3, 9, 0, 4], "_now": 0, "_now_ms": 70}
    )
    for size in (1, 2, 6):
        state = State(watermark=90)
        parts = [rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, 6, size)]
        out = pd.concat(I._first_of_id(1000)(("k",), iter(parts), state))
        assert sorted(out["x"]) == list("abcdef")
        assert set(out.loc[out["_repeated"], "x"]) == set("adf")
        assert (state.value, state.until) == ((70,), 1090)
    state.hasTimedOut = True
    assert list(I._first_of_id(1000)(("k",), iter([]), state)) == [] and not state.exists


def test_the_state_has_parts_of_ids_and_not_a_key_for_each(population, tmp_path, spark, monkeypatch):
    monkeypatch.setattr(I, "PARTS", 8)
    twice = population.filter(F.col(S.ID).isNotNull())
    for n in (1, 2):
        twice.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        checked = I.unique_stream(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in")))
        query = I.write_available(checked, tmp_path / "out", tmp_path / "progress")
        query.awaitTermination()
        assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 8
    out = spark.read.schema(checked.schema).parquet(str(tmp_path / "out")).collect()
    valid = {r[S.ID] for r in I.checked_stream(twice).filter(F.size("violations") == 0).collect()}
    assert len(valid) > 8 and passed(out) == Counter(valid)
    assert Counter(r[S.ID] for r in out if I.REPEATED in r["violations"]) == Counter(valid)


def test_ids_of_one_part_are_forgotten_one_by_one():
    import pandas as pd

    class Part(State):
        @property
        def get(self):
            return self.value

    def come(ids, now):
        rows = pd.DataFrame({"x": ids, "_valid": True, "_order": 0, "_id": ids, "_now": 0, "_now_ms": now})
        out = pd.concat(I._first_of_ids(100)((0,), iter([rows]), state))
        return dict(zip(out["x"], out["_repeated"]))

    state = Part()
    assert come(["a", "b"], 10) == {"a": False, "b": False}
    assert come(["a", "c"], 60) == {"a": True, "c": False}
    assert (dict(zip(*state.value)), state.until) == ({"a": 60, "b": 10, "c": 60}, 110)
    assert come(["b", "c"], 115) == {"b": False, "c": True}
    state.watermark, state.hasTimedOut = 165, True
    assert list(I._first_of_ids(100)((0,), iter([]), state)) == [] and dict(zip(*state.value)) == {"b": 115, "c": 115}
    state.watermark = 300
    assert list(I._first_of_ids(100)((0,), iter([]), state)) == [] and not state.exists
