import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import resampling

from .conftest import FOLDER, ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _features(text, longest):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus = Counter(bucket(f) for _, t in rows for f in _features(t, longest)[1])
    wanted = Counter(bucket(f) for t in target for f in _features(t, longest)[1])
    n_corpus, n_wanted = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(
            1000 * math.log((wanted[b] + 1) * (n_corpus + buckets) / ((corpus[b] + 1) * (n_wanted + buckets)))
        )

    out = []
    for doc_id, text in rows:
        words, features = _features(text, longest)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(features), weight, score, len(words) >= least))
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(may[: len(may) * percent // 100])]
    rest = [(*r[:4], None) for r in may[len(drawn) :]] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(drawn + rest, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark, documents, rows):
    target = pd.read_parquet(f"{FOLDER}/benchmark.parquet")["text"].tolist()
    found = _found(resampling.resampled(documents, spark.read.parquet(f"{FOLDER}/benchmark.parquet")))
    assert found == _brute(list(zip(rows["doc_id"].tolist(), rows["text"])), target)


def test_longer_runs(spark, documents, rows):
    target = pd.read_parquet(f"{FOLDER}/benchmark.parquet")["text"].tolist()
    some = documents.where("doc_id < 60")
    table = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = _found(resampling.resampled(some, table, longest=3, buckets=97, least_words=5, percent=50))
    pairs = [p for p in zip(rows["doc_id"].tolist(), rows["text"]) if p[0] < 60]
    assert found == _brute(pairs, target, 3, 97, 5, 50)


def test_odd_rows(spark, odd, nothing):
    pairs = [r[:2] for r in ODD]
    texts = [r[1] for r in ODD[:6]]
    target = spark.createDataFrame([(t,) for t in texts], "text string")
    found = resampling.resampled(odd, target, least_words=1, percent=60)
    assert _found(found) == _brute(pairs, texts, least=1, percent=60)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _found(resampling.resampled(odd, nothing)) == _brute(pairs, [])
    assert resampling.resampled(nothing, target).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ09 .-_é日\x00\x7f\n\t`{", max_size=40), st.integers(1, 4))
def test_spans_are_all_runs_of_words(text, longest):
    patterns = [resampling.spans_pattern(n + 1) for n in range(longest)]
    found = [s.decode() for spans in resampling._spans(text.encode(), patterns) for s in spans]
    assert found == _features(text, longest)[1]
