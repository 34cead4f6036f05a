import numpy as np
import pyarrow as pa

from ebbtide.llm import token_counts
from ebbtide.llm.text import WordEncoder, vocabulary

from .conftest import ODD


def _brute(lengths, limit):
    lengths = np.array(lengths)
    at_least = lengths >= limit
    return at_least.sum(), lengths[at_least].sum(), np.minimum(lengths, limit).sum()


def test_suffix_sums_equal_brute_force(documents, rows, tokenizer):
    lengths = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in rows["text"]]
    found = token_counts.with_suffix_sums(token_counts.length_histogram(documents)).collect()
    assert {r["length"]: r["documents"] for r in found} == {n: lengths.count(n) for n in lengths}
    for r in found:
        assert (r["documents_at_least"], r["tokens_at_least"], r["tokens_truncated"]) == _brute(lengths, r["length"])
        assert abs(r["share_at_most"] - np.mean(np.array(lengths) <= r["length"])) < 1e-12


def test_limits_and_quantiles(spark):
    lengths = [0, 3, 3, 5, 2000, 2000, 5000]
    histogram = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length long, documents long")
    sums = token_counts.with_suffix_sums(histogram)
    limits = [0, 1, 3, 4, 4999, 5000, 9000]
    answers = {r["context_limit"]: r for r in token_counts.at_limits(sums, limits).collect()}
    for limit in limits:
        assert answers[limit]["documents_cut"] == sum(n > limit for n in lengths)
        assert answers[limit]["tokens_truncated"] == sum(min(n, limit) for n in lengths)
    shares = {r["share"]: r["length"] for r in token_counts.length_quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert shares == {0.1: 0, 0.5: 5, 1.0: 5000}


def test_odd_rows(odd, nothing, tokenizer):
    lengths = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD]
    found = token_counts.length_histogram(odd).collect()
    assert {r["length"]: r["documents"] for r in found} == {n: lengths.count(n) for n in lengths}
    empty = token_counts.with_suffix_sums(token_counts.length_histogram(nothing))
    assert empty.count() == 0
    assert token_counts.at_limits(empty, [5]).head()["tokens_truncated"] == 0
    assert token_counts.length_quantiles(empty, [0.5]).head()["length"] is None


def test_encoder_equals_library_even_when_it_forgets(rows, tokenizer):
    odd = [r[1] for r in ODD if r[1]] + ["  a b", "a\x0bb\x0cc\x1cd e", "é e ́x", "ΣΑΣ Σ İstanbul"]
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), limit=50)
    for texts in (odd, rows["text"].tolist()[:60], odd):
        ids = [x.tolist() for x in encoder.encode_each(pa.array(texts, pa.string()))]
        assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
