from hypothesis import given
from hypothesis import strategies as st

from ebbtide.llm import line_alignment as L
from ebbtide.llm import queries

from .conftest import FOLDER, row

LONG = ["a line with enough characters %d" % i for i in range(12)]


@given(st.lists(st.sampled_from("abcdefgh"), max_size=12), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_patience_is_an_ordered_alignment(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    if a == b:
        assert pairs == [(i, i) for i in range(len(a))]


def test_unique_lines_anchor_in_their_longest_common_order():
    a = ["x", "p", "q", "r", "s"]
    b = ["p", "r", "q", "s", "y"]
    assert [a[i] for i, _ in L.patience(a, b)] in (["p", "q", "s"], ["p", "r", "s"])


def _clean(spark, odd, *texts):
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    found = L.without_repeated_lines(frame)
    return {r["row"]["doc_id"]: r["cleaned"] for r in found.collect()}


def test_later_documents_lose_aligned_blocks(spark, odd):
    first = "\n".join(LONG[:4])
    later = "\n".join(["own start of the later text", *LONG[1:3], "own end of the later text"])
    other = "nothing in common with the others here"
    found = _clean(spark, odd, first, later, other)
    assert found == {0: first, 1: "own start of the later text\nown end of the later text", 2: other}


def test_every_holder_of_a_common_line_is_aligned(spark, odd):
    texts = [f"{LONG[0]}\nline number {i} of its own is here" for i in range(30)]
    found = _clean(spark, odd, *texts)
    assert found[0] == texts[0]
    assert all(found[i] == f"line number {i} of its own is here" for i in range(1, 30))


def test_short_lines_alone_do_not_go(spark, odd):
    texts = ["Of.\nsome words that only one text has", "Of.\nother words that nothing else has"]
    assert _clean(spark, odd, *texts) == dict(enumerate(texts))


def _trimmed(text):
    return [x.replace("\r", " ").replace("\t", " ").strip(" ") for x in text.split("\n")]


def _brute(rows):
    """Places of every text that alignments with all earlier texts remove, all pairs one by one."""
    lines = [_trimmed(t) for _, t in sorted(rows)]
    seeds = [{x for x in own if len(x) >= L.SEED_CHARS} for own in lines]
    gone = []
    for d, own in enumerate(lines):
        places = set()
        for e in range(d):
            if seeds[d] & seeds[e]:
                places |= set(L.repeated_places(lines[e], own, [len(x) for x in own]))
        gone.append(places)
    return dict(zip(sorted(d for d, _ in rows), zip(lines, seeds, gone)))


def test_whole_table_equals_brute_force(documents, rows):
    brute = _brute(list(zip(rows["doc_id"], rows["text"])))
    found = {r["id"]: set(r["gone"]) for r in L.deleted_lines(documents).collect()}
    assert len(found) > 5
    for doc, (own, seeds, gone) in brute.items():
        places = found.get(doc, set())
        # Nothing goes without an alignment; of seed lines, all go that the alignment with any earlier document removes.
        assert places <= gone
        assert {i for i in gone if own[i] in seeds and own.count(own[i]) == 1} <= places
    texts = dict(zip(rows["doc_id"], rows["text"]))
    for r in L.without_repeated_lines(documents).collect():
        doc, gone = r["row"]["doc_id"], found.get(r["row"]["doc_id"], set())
        kept = [x for i, x in enumerate(texts[doc].split("\n")) if i not in gone]
        assert (r["cleaned"], r["n_gone"]) == ("\n".join(kept), len(gone))


def test_headings_found_twice_lead_to_no_pairs_of_all(spark, odd):
    heading = "A heading that every document repeats"
    texts = [f"start {i}\n{heading}\nmiddle number {i} of the text\n{heading}\nend {i}" for i in range(60)]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    held = L.line_holders(L.with_turns(L.with_lines(frame)))
    assert held.where("line is not null and not once").count() == 60 and held.where("once").count() == 0
    assert L.overlapping(held).count() == 59
    assert _clean(spark, odd, *texts) == dict(enumerate(texts))


def test_rows_that_share_an_id_or_have_none_are_ordered(spark, odd):
    texts = ["\n".join([*LONG[:3], f"the end of number {i}, its own"]) for i in range(8)]
    for ids in ([None] * 8, [7] * 8, [1, 1, 2, 2, None, None, 3, 3]):
        frame = spark.createDataFrame([row(d, t) for d, t in zip(ids, texts)], odd.schema)
        cleaned = [r["cleaned"] for r in L.without_repeated_lines(frame).collect()]
        assert sum(LONG[0] in t for t in cleaned) == sum(LONG[2] in t for t in cleaned) == 1
        assert sorted(t.split("\n")[-1] for t in cleaned) == sorted(t.split("\n")[-1] for t in texts)


def test_odd_rows(odd, nothing):
    found = [(r["row"]["doc_id"], r["row"]["text"], r["cleaned"]) for r in L.without_repeated_lines(odd).collect()]
    assert len(found) == odd.count()
    changed = sorted(str(d) for d, before, after in found if before != after)
    # The copy, the text that starts with it, and both rows without an id (11 has their line and an id).
    assert changed == ["5", "6", "None", "None"]
    kept = L.with_lines_deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None not in ids and 5 not in ids and ids.count(10) == 3 and {2, 3, 4} <= set(ids)
    assert kept.where("doc_id = 6").head()["n_chars"] == 50
    assert L.without_repeated_lines(nothing).count() == 0
    assert L.with_lines_deduplicated(nothing).count() == 0


def _seeds_kept(texts, cleaned):
    """Seed lines that stay although the alignment with some earlier holder, of all there are, removes them."""
    lines = [_trimmed(t) for t in texts]
    seeds = [{x for x in own if len(x) >= L.SEED_CHARS} for own in lines]
    kept = set()
    for d, own in enumerate(lines):
        left = set(_trimmed(cleaned[d]))
        for e in range(d):
            if seeds[d] & seeds[e]:
                once = {own[j] for j in L.repeated_places(lines[e], own, [len(x) for x in own]) if own.count(own[j]) == 1}
                kept |= {(d, x) for x in once & seeds[d] & left}
    return kept


def test_common_lines_go_if_any_earlier_holder_removes_them(spark, odd):
    # The first document has the lines in another order, so its alignment leaves one of them in each later one.
    texts = ["\n".join([LONG[1], LONG[0], LONG[2]])]
    texts += ["\n".join([f"document {i} starts with a line of its own", *LONG[:3], f"end {i}"]) for i in range(12)]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    every = {r["row"]["doc_id"]: r["cleaned"] for r in L.without_repeated_lines(frame).collect()}
    assert not _seeds_kept(texts, every)
    assert all(every[d] == f"document {d - 1} starts with a line of its own\nend {d - 1}" for d in range(2, 13))


def test_registered_query_tries_every_holder(spark, rows):
    found = {r["doc_id"]: r["text"] for r in queries.op3_line_alignment(spark, FOLDER).collect()}
    assert not _seeds_kept(list(rows["text"]), [found[d] for d in rows["doc_id"]])


def test_texts_are_cut_once(documents):
    cleaned = L.with_lines_deduplicated(documents)
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_no_plan_grows_with_the_rounds(spark, odd):
    texts = ["\n".join([LONG[1], LONG[0], LONG[2]])]
    texts += ["\n".join([f"document {i} starts with a line of its own", LONG[0], f"end {i}", LONG[1]]) for i in range(40)]
    frame = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], odd.schema)
    found = L.deleted_lines(frame)
    # What the rounds found is read by one scan, and rounds there were.
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert len({file.rsplit("/", 2)[1] for file in found.inputFiles()}) > 2
