import itertools
import zlib

import numpy as np
import pytest

from ebbtide.llm import language

from .conftest import ODD


@pytest.fixture(scope="module")
def predictions(documents):
    return {r["doc_id"]: r for r in language.predicted_languages(documents).collect()}


def test_held_out_accuracy(predictions, rows):
    held = [d for d in rows["doc_id"] if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in predictions.items() if r["held_out"]} == set(held)
    lang = dict(zip(rows["doc_id"], rows["lang"]))
    right = [predictions[d]["lang_pred"] == lang[d] for d in held]
    assert np.mean(right) >= 0.97
    assert all(0.0 <= r["score"] <= 1.0 for r in predictions.values())


def _segmentations(word, numbers):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in numbers or len(p) == 1 for p in parts):
            yield parts


def test_forward_and_counts_sum_over_all_segmentations():
    numbers = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba"])}
    rng = np.random.default_rng(0)
    probability = np.vstack([rng.random((7, 2)), np.full((1, 2), language.UNKNOWN), np.zeros((1, 2))])
    words = ["▁abab", "▁a", "▁bxa", "▁aab"]
    found = language.forward(words, numbers, probability)
    for word, got in zip(words, found):
        total, counts = np.zeros(2), {}
        for parts in _segmentations(word, numbers):
            p = np.prod([probability[numbers.get(x, 7)] for x in parts], axis=0)
            total += p
            for x in parts:
                if x in numbers:
                    counts[numbers[x]] = counts.get(numbers[x], 0.0) + p[0]
        assert np.allclose(got, total)
        expected = language.expected_pieces(word, numbers, probability[:, 0].tolist())
        assert {k: pytest.approx(v / total[0]) for k, v in counts.items()} == dict(expected)


def test_labels_are_no_input(documents, predictions):
    from pyspark.sql import functions as F

    model = language.fit_languages(documents)
    bare = language.identified(documents.select("doc_id", "text").withColumn("lang", F.lit("zz")), model)
    assert all(r["language"]["lang_pred"] == predictions[r["doc_id"]]["lang_pred"] for r in bare.collect())


def test_odd_rows(odd, nothing):
    found = language.predicted_languages(odd).collect()
    assert len(found) == len(ODD)
    known = {r[2] for r in ODD if r[2] and r[0] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5}
    assert {r["lang_pred"] for r in found} <= known | {"und"}
    und = sorted(r["doc_id"] for r in found if r["lang_pred"] == "und")
    assert und == [2, 3, 4, 9] and all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    assert language.predicted_languages(nothing).count() == 0
    kept = language.with_known_language(odd)
    assert kept.columns == odd.columns and {2, 3, 4, 9}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_texts_are_told_once_where_answers_are_filtered(documents):
    plan = language.with_known_language(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_all_words_are_followed_together(monkeypatch):
    numbers = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba"])}
    rng = np.random.default_rng(1)
    probability = np.vstack([rng.random((7, 2)), np.full((1, 2), language.UNKNOWN), np.zeros((1, 2))])
    words = ["▁" + "".join(rng.choice(list("abx\U0001f600"), rng.integers(1, 9))) for _ in range(3_000)]
    calls, follow = [], language.Steps.next
    monkeypatch.setattr(language.Steps, "next", lambda self, *a: calls.append(1) or follow(self, *a))
    found = language.forward(words, numbers, probability)
    assert len(calls) <= 9 * (3 + 1)  # places of the longest word, times characters of the longest piece and one
    for i in range(0, 3_000, 100):
        alone = sum(np.prod([probability[numbers.get(x, 7)] for x in p], axis=0) for p in _segmentations(words[i], numbers))
        assert np.allclose(found[i], alone)


def test_runs_are_words_of_letters(monkeypatch):
    long_run = "ab²" * 50  # 100 letters
    text = f"One one x²y ½ ² 12 a_b {long_run}"
    assert language.runs_of(text) == {"one": 2, "x²y": 1, "½": 1, "²": 1, "a": 1, "b": 1, "ab" * 20: 2, "ab" * 10: 1}
    assert language.words_of(["one", "½", "x²y"]) == ["▁one", "▁xy"]
    numbers = {p: i for i, p in enumerate(["▁", "o", "n", "e", "x", "y", "xy"])}
    probability = np.vstack([np.full((7, 2), [0.1, 0.05]), np.full((1, 2), language.UNKNOWN), np.zeros((1, 2))])
    steps = language.Steps(numbers)
    monkeypatch.setattr(language, "steps_of", lambda path: steps)
    model = language.LanguageModel(["p", "q"], [1, 1], probability, "none")
    found = model.predict_all(["½ ²", None, "one", "½ one", "x²y", "xy", "½"])
    assert [f[0] for f in found] == ["und", "und", "p", "p", "p", "p", "und"]
    assert found[2] == found[3] and found[4] == found[5] and found[0][1] == 0.0
