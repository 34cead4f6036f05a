import math
import re
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st

from ebbtide.llm import fertility
from ebbtide.llm.text import vocabulary

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _repeated(words, n=8):
    windows = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    covered = set()
    for i in range(len(words) - n + 1):
        if windows[tuple(words[i : i + n])] > 1:
            covered |= set(range(i, i + n))
    return len(covered)


def _base(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = _repeated(words)
    failed = len(words) < 20 or 100 * n > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, n, failed


@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_windows_equal_brute_force(words):
    assert fertility.repeated_window_words(words) == _repeated(words)
    assert fertility.repeated_window_words(words, 3) == _repeated(words, 3)


def test_measures_are_those_of_the_vocabulary():
    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = fertility.PieceCounter(path)
    words = "a cat saw 日 \U0001f600 a mat".encode().split()
    counter.learn(words)
    ids = [i for w in words for i in model.encode(w.decode())]
    share = [n / len(ids) for n in Counter(ids).values()]
    expected = len(ids), sum(model.is_byte(i) for i in ids), pytest.approx(-sum(p * math.log2(p) for p in share))
    assert counter.measures(Counter(words)) == expected
    assert counter.measures(Counter()) == (0, 0, 0.0)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_whole_table(documents, rows):
    found = {r["doc_id"]: r for r in fertility.quality_verdicts(documents).collect()}
    for d, text in zip(rows["doc_id"], rows["text"]):
        r = found[d]
        assert tuple(r[c] for c in COLUMNS) == _base(text)
        inside = all(
            r[c] is None or r[f"{c}_from"] is None or r[f"{c}_from"] <= r[c] <= r[f"{c}_to"]
            for c in fertility.LEAST_MARGIN
        )
        assert r["kept"] == (not r["base_failed"] and inside)


def test_junk_goes_and_prose_stays(spark):
    prose = [f"The keeper of lighthouse {i} wrote that the sea was calm and the ships all came safely home before dark again." for i in range(80)]
    junk = ["".join(chr(0x2500 + (i * 7) % 120) + " " for i in range(20)), " ".join(f"zq{i}x#k" for i in range(19)) + " v"]
    texts = [(i, t, "en") for i, t in enumerate(prose + junk)]
    found = fertility.quality_verdicts(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {80, 81} | {r["doc_id"] for r in found if r["base_failed"]}
    assert not any(r["base_failed"] for r in found if r["doc_id"] < 80)


def _box(i):
    return " ".join(chr(0x2500 + (i * 7 + k) % 120) * (1 + k % 3) for k in range(24))


def _prose(i):
    return f"The keeper of lighthouse {i} wrote that the sea was calm and the ships all came safely home before dark again."


def test_small_groups_take_the_band_of_their_script_or_of_all_texts(spark):
    prose = [(i, _prose(i), "en") for i in range(200)]
    rare = [(1000 + i, _prose(500 + i), "xx") for i in range(5)]  # few texts, but of a script with a band
    junk = [(2000 + i, _box(i), "yy") for i in range(39)]
    found = fertility.quality_verdicts(
        spark.createDataFrame(prose + rare + junk, "doc_id long, text string, lang string")
    ).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if not r["kept"]} == {i for i, *_ in junk}


def test_bands_do_not_depend_on_the_partitioning(documents, rows):
    """Ends equal quartiles of the rounded values of the narrowest group with enough texts."""
    few, many = [
        {(r["doc_id"], *[r[f"{c}_{e}"] for c in fertility.LEAST_MARGIN for e in ("from", "to")], r["kept"])
         for r in fertility.quality_verdicts(documents.repartition(n)).collect()}
        for n in (1, 13)
    ]
    assert few == many
    found = [r for r in fertility.quality_verdicts(documents).collect() if r["chars_per_token"] is not None]
    size = lambda r: int(math.log2(max(r["n_words"], 1)))
    sizes, kinds = Counter((r["kind"], size(r)) for r in found), Counter(r["kind"] for r in found)
    checked = 0
    for r in found[::7]:
        if sizes[(r["kind"], size(r))] >= fertility.LEAST_GROUP:
            group = [x for x in found if (x["kind"], size(x)) == (r["kind"], size(r))]
        elif kinds[r["kind"]] >= fertility.LEAST_GROUP:
            group = [x for x in found if x["kind"] == r["kind"]]
        else:
            continue
        checked += 1
        for c, least in fertility.LEAST_MARGIN.items():
            values = sorted(round(x[c], fertility.DECIMALS[c]) for x in group)
            lo, hi = [values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75)]
            margin = max(3.0 * (hi - lo), least)
            assert r[f"{c}_from"] == pytest.approx(lo - margin, abs=1e-3)
            assert r[f"{c}_to"] == pytest.approx(hi + margin, abs=1e-3)
    assert checked


def test_odd_rows(odd, nothing):
    found = fertility.quality_verdicts(odd).collect()
    assert sorted(tuple(str(r[c]) for c in ["doc_id", *COLUMNS]) for r in found) == sorted(
        (str(r[0]), *map(str, _base(r[1]))) for r in ODD
    )
    assert fertility.quality_verdicts(nothing).count() == 0
