import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ebbtide.llm import shingle_sets, simhash
from ebbtide.llm.components import connected_components

from .conftest import ODD, words


def _fingerprint(text, n=4):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fingerprints, radius):
    label = list(range(len(fingerprints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array(fingerprints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_whole_table_equals_brute_force(documents, rows):
    fingerprints = [_fingerprint(t) for t in rows["text"]]
    smallest = [int(rows["doc_id"][k]) for k in _components(fingerprints, 4)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    assert [found[d]["fingerprint"] for d in rows["doc_id"]] == [f"{f:016x}" for f in fingerprints]
    assert [found[d]["component_id"] for d in rows["doc_id"]] == smallest


def test_words_are_bytes_between_ascii_white_space():
    assert words("a b\x1cc d\x0be") == ["a b\x1cc".encode(), b"d", b"e"]
    assert simhash.fingerprint_of(b" \n") == 0
    assert simhash.fingerprint_of(b"A b") == simhash.fingerprint_of(b"a\t\nB ")


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_links_of_dense_and_chained_fingerprints(spark, radius):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(2**63))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 40, 3) for b in range(1, 60, 7)}  # dense
    chain = int(rng.integers(2**63))
    for step in range(12):  # each link at the radius, the ends far apart
        for k in range(radius):
            chain ^= 1 << (step * radius + k)
        values.add(chain)
    values |= {int(x) for x in rng.integers(2**63, size=200)} | {0, 2**63 - 1}
    values = sorted(values)
    label = _components(values, radius)
    frame = spark.createDataFrame([(v, v) for v in values], "node long, f0 long")
    found = {r["node"]: r["component"] for r in simhash.linked_fingerprints(frame, radius).collect()}
    assert [found.get(v, v) for v in values] == [values[k] for k in label]


def test_pivots_never_discard_a_link(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(300):
        a = int(rng.integers(-(2**63), 2**63))
        b = a
        for bit in rng.choice(63, size=int(rng.integers(0, 9)), replace=False):
            b ^= 1 << int(bit)
        pairs.append((a, b, (a ^ b).bit_count()))
    frame = spark.createDataFrame(pairs, "a long, b long, distance int")
    tables = simhash.with_pivots(simhash.with_pivots(frame, ["a"], "p"), ["b"], "q")
    kept = {(r["a"], r["b"]) for r in tables.where(simhash._within_pivots("p", "q", 4)).collect()}
    assert all((a, b) in kept for a, b, d in pairs if d <= 4)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (160, 100)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {x: 7 for x in range(200, 260)}


def test_odd_rows(odd, nothing):
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    fingerprints = [_fingerprint(r[1]) for r in ODD]
    label = _components(fingerprints, 4)
    smallest = [min((ODD[j][0] for j in range(len(ODD)) if label[j] == k and ODD[j][0]), default=None) for k in label]
    assert found == sorted((str(r[0]), f"{f:016x}", s) for r, f, s in zip(ODD, fingerprints, smallest))
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_document_of_each_group_stays(odd, nothing):
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == 10  # two different texts share the doc_id 10
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, 9, 10, 11, 12}
    assert simhash.without_near_duplicates(nothing).count() == 0


def _similarity(a, b, n=5):
    a, b = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(9)
    texts, copies = [], []
    for k in range(60):
        base = [f"w{i}" for i in rng.integers(5000, size=400)]
        texts.append(base)
        copy = list(base)
        for i in rng.choice(400, size=int(rng.integers(1, 9)), replace=False):
            copy[i] = f"new{k}x{i}"
        texts.append(copy)
        copies.append(_similarity(base, copy))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(frame).collect()}
    assert {2 * k for k in range(60)} <= kept
    near = [k for k, s in enumerate(copies) if s >= 0.85]
    assert len(near) > 30
    assert sum(2 * k + 1 not in kept for k in near) >= 0.95 * len(near)


def _edited(rng, k, low, high):
    """A text of 400 words and a copy whose five-word similarity lies between ``low`` and ``high``."""
    base = [f"w{i}" for i in rng.integers(5000, size=400)]
    copy, places = list(base), rng.permutation(400)
    for n, i in enumerate(places):
        if low <= _similarity(base, copy) < high and rng.random() < 0.5:
            break
        changed = [*copy[:i], f"new{k}x{i}", *copy[i + 1 :]]
        if _similarity(base, changed) >= low:
            copy = changed
    assert low <= _similarity(base, copy) < high
    return base, copy


def _kept(spark, texts):
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in simhash.without_near_duplicates(frame).collect()}


def test_every_pair_just_over_the_threshold_is_found(spark):
    rng = np.random.default_rng(3)
    texts = [t for k in range(150) for t in _edited(rng, k, 0.8, 0.85)]
    assert _kept(spark, texts) == set(range(0, 300, 2))


def test_pairs_under_the_threshold_all_stay(spark):
    rng = np.random.default_rng(4)
    texts = [t for k in range(60) for t in _edited(rng, k, 0.7, 0.78)]
    assert _kept(spark, texts) == set(range(120))


def test_fingerprints_decide_which_sets_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [t for k in range(10) for t in _edited(rng, k, 0.8, 0.85)]
    monkeypatch.setattr(simhash, "SET_RADIUS", -1)
    assert _kept(spark, texts) == set(range(20))


def test_the_reach_holds_similar_sets_and_leaves_others_out():
    rng = np.random.default_rng(6)
    prints = lambda x: simhash._prints(x, simhash.SET_PRINTS)
    apart = lambda x, y: sum(((a ^ b) % 2**64).bit_count() for a, b in zip(prints(x), prints(y)))
    for n in (simhash.SHORT_SET, 60, 400):
        for _ in range(60):
            every = rng.integers(2**63, size=2 * n + 10, dtype=np.uint64)
            more = n + n // 4
            assert apart(every[:n], every[:more]) <= simhash.SET_RADIUS  # 0.8
            assert apart(every[:n], every[n // 10 : n + n // 10]) <= simhash.SET_RADIUS  # 0.82
            assert apart(every[:n], every[n : 2 * n]) > simhash.SET_RADIUS


def test_sets_and_places_leave_a_worker_in_small_batches():
    texts = [b"", *[b" ".join(b"%d" % (i * k % 97) for i in range(1 + k % 60)) for k in range(1, 2 * shingle_sets.BATCH_TEXTS)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["node", "bytes"])
    sets = list(shingle_sets._set_batches([batch.slice(0, 0), batch], simhash._set_prints, simhash.SET_PRINTS))
    assert max(b.num_rows for b in sets) <= shingle_sets.BATCH_TEXTS
    whole = pa.Table.from_batches(sets)
    assert whole["node"].to_pylist() == list(range(len(texts)))
    expected = [shingle_sets.shingles_of(t) for t in texts]
    assert whole["shingles"].to_pylist() == [s.tolist() for s in expected]
    assert whole["n"].to_pylist() == [len(s) for s in expected]
    prints = [whole[f"f{i}"].to_pylist() for i in range(simhash.SET_PRINTS)]
    assert [list(p) for p in zip(*prints)] == [simhash._set_prints(s.view(np.uint64)) for s in expected]

    common, counts = np.unique(np.concatenate(expected), return_counts=True)
    batch = whole.select(["node", "n", "shingles"]).combine_chunks().to_batches()[0]
    places = list(shingle_sets._place_batches([batch], common, counts))
    assert len(places) == len(sets)
    found = [(r["node"], r["n"], r["at"], r["place"]) for b in places for r in b.to_pylist()]
    assert found == [
        (k, len(s), at, int(p)) for k, s in enumerate(expected) for at, p in enumerate(shingle_sets.prefix_of(s, common, counts))
    ]
