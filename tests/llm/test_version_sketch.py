import hashlib

import numpy as np
import pytest

from ebbtide.llm import version_sketch as V

from .conftest import ODD, row


def _likeness(a, b):
    a, b = set(a.split("\n")), set(b.split("\n"))
    return len(a & b) / len(a | b)


def _check(found, ordered):
    """``ordered``: texts in ring order; found rows by their text's place."""
    for i, text in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(_likeness(text, edited))
        assert r["near_next"] == pytest.approx(_likeness(text, after))


def test_whole_table(documents, rows):
    found = {r["doc_id"]: r for r in V.fingerprinted(documents).collect()}
    _check([found[d] for d in rows["doc_id"]], rows["text"].tolist())
    prints = {}
    for d, text in zip(rows["doc_id"], rows["text"]):
        assert prints.setdefault(text, found[d]["fingerprint"]) == found[d]["fingerprint"]


def test_large_differences_are_tried_again(spark, odd):
    rng = np.random.default_rng(3)
    lines = [f"line {i}" for i in rng.integers(10**9, size=900)]
    texts = ["\n".join(lines[:700]), "\n".join(lines[100:900]), "\n".join(lines[:1]), "", "\n".join(lines)]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    found = {r["doc_id"]: r for r in V.fingerprinted(frame).collect()}
    _check([found[i] for i in range(len(texts))], texts)


def test_odd_rows(odd, nothing):
    found = V.fingerprinted(odd).collect()
    assert len(found) == len(ODD)
    assert {r["n_chars"] for r in found if r["doc_id"] == 2} == {0}
    repeated = [tuple(r) for r in found if r["doc_id"] == 10 and r["n_chars"] == 3]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    last = next(r for r in found if r["doc_id"] is None)  # after the last comes the first
    text, first = next(r[1] for r in ODD if r[0] is None), ODD[0][1]
    quarter = len(text) // 4
    assert last["edited_sha256"] == hashlib.sha256((text[: len(text) - quarter] + first[:quarter]).encode()).hexdigest()
    assert V.fingerprinted(nothing).count() == 0


def test_a_single_document_is_its_own_next(spark, odd):
    found = V.fingerprinted(spark.createDataFrame([row(1, "ab\ncd")], odd.schema)).collect()
    assert len(found) == 1 and found[0]["near_next"] == 1.0
