from hypothesis import given
from hypothesis import strategies as st

from ebbtide.llm import sentence_spans as S

from .conftest import row

PASSAGE = " ".join(f"Sentence {i} of the passage tells of {i} ships." for i in range(8))


@given(st.text(alphabet="ab .!?\n\té", max_size=200))
def test_pieces_tile_the_text(text):
    raw = text.encode()
    ends, words = S.sentences_of(raw, longest=3)
    assert sorted(ends) == ends and (not raw or ends[-1] == len(raw))
    assert [w for part in words for w in part] == raw.lower().split()


def _clean(spark, odd, texts):
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    return {r["row"]["doc_id"]: r for r in S.without_repeated_spans(frame).collect()}


def test_passage_goes_from_all_but_the_first(spark, odd):
    texts = [f"Opening words number {i} are new. {PASSAGE} Closing words number {i} are new, too." for i in range(9)]
    found = _clean(spark, odd, texts)
    assert found[0]["cleaned"] == texts[0] and found[0]["removed"] == []
    for i in range(1, 9):
        assert found[i]["cleaned"] == f"Opening words number {i} are new. Closing words number {i} are new, too."
        (span,) = found[i]["removed"]
        assert texts[i][span["start"] : span["end"]].strip() == PASSAGE


def test_long_stretches_without_sentence_ends(spark, odd):
    stretch = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
    texts = [f"a b c {stretch} d e f", f"g h {stretch} i"]
    left = _clean(spark, odd, texts)[1]["cleaned"].split()
    assert sum(w in stretch.split() for w in left) < 30 and {"g", "h", "i"} <= set(left)


def test_repeats_within_a_text(spark, odd):
    found = _clean(spark, odd, [f"{PASSAGE} Something else stands here. {PASSAGE}"])
    assert found[0]["cleaned"].strip() == f"{PASSAGE} Something else stands here."


def _brute(rows):
    first, spans = {}, {}
    for d, text in rows:
        spans[d] = S.spans_of(text.encode())
        for at, _, h in spans[d]:
            first[h] = min(first.get(h, (d, at)), (d, at))
    return {d: {k for at, n, h in v if first[h] != (d, at) for k in range(at, at + n)} for d, v in spans.items()}


def test_whole_table_equals_brute_force(documents, rows):
    gone = _brute(zip(rows["doc_id"], rows["text"]))
    for r in S.without_repeated_spans(documents).collect():
        doc, raw = r["row"]["doc_id"], r["row"]["text"].encode()
        ends, _ = S.sentences_of(raw)
        parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
        assert r["cleaned"].encode() == b"".join(p for k, p in enumerate(parts) if k not in gone[doc])


def test_odd_rows(odd, nothing):
    found = S.without_repeated_spans(odd).collect()
    assert len(found) == odd.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r["row"]["doc_id"], []).append((r["row"]["text"], r["cleaned"]))
    assert by_id[2] == [(None, None)] and by_id[3] == [("", "")]
    assert by_id[1][0][0] == by_id[1][0][1] and by_id[5][0][1] == ""
    assert by_id[7][0][0] == by_id[7][0][1] and by_id[8][0][0] == by_id[8][0][1]  # one sentence without a place to cut
    assert all(before == after for before, after in by_id[10])
    assert S.without_repeated_spans(nothing).count() == 0
