import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import prefix_trie

from .conftest import FOLDER

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string, part string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _brute_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, _digest(role, text).hex(), role, text))
    plain = {c: [t[3:] for t in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + own[h:]
    return out


def _brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[c] for c in children[p])
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
            _sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))),
        )
        for p, m in members.items()
    )


def _found(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in (tuple(r) for r in df.collect()))


def _items(convs):
    paths = sorted((b"".join(_digest(*t) for t in turns), c) for c, turns in convs.items())
    return [prefix_trie.Item(p, [len(t[1]) for t in convs[c]], 1, c, ids=[c]) for p, c in paths]


def _by_parts(convs, cuts):
    """The trie from forests of neighbouring parts, merged once, in plain Python."""
    items = _items(convs)
    bounds = [0, *sorted(c for c in cuts if 0 < c < len(items)), len(items)]
    nodes, opened, ends = [], [], defaultdict(list)
    root = prefix_trie.Item(b"", [])
    for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            rows = prefix_trie.forest([root, *items[a:b]], part, items[a].path, items[b - 1].path, False)
            nodes += [r for r in rows if r["kind"] == prefix_trie.NODE]
            opened += [r for r in rows if r["kind"] == prefix_trie.OPEN]
            for r in rows:
                if r["kind"] == prefix_trie.ENDS:
                    ends[r["key"]].append(r["ids"])
    again = [root]
    for r in sorted(opened, key=lambda r: (r["path"], r["part"])):
        known = (r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"])
        again.append(prefix_trie.Item(r["path"], r["chars"], *known))
    late = prefix_trie.forest(again, 0, None, None, True)
    above = {r["key"]: r["conv_id"] for r in late if r["key"]}
    out = []
    for r in nodes + late:
        sha = r["ends_sha256"] or _sha(",".join(ends[r["key"]]))
        parent = above[r["parent_key"]] if r["parent_key"] else -1 if r["parent_conv_id"] is None else r["parent_conv_id"]
        out.append((r["conv_id"], r["depth"], parent, *(r[c] for c in prefix_trie.OUT[3:7]), sha))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=5), min_size=1, max_size=14),
    st.lists(st.integers(1, 13), max_size=4, unique=True),
)
def test_forests_of_parts_equal_brute_force(texts, cuts):
    convs = {i: [("user", t) for t in own] for i, own in enumerate(texts)}
    assert _by_parts(convs, cuts) == _brute(convs)


@pytest.mark.parametrize("per_task", [prefix_trie.PATHS, 3])
def test_whole_table(spark, per_task):
    found = prefix_trie.prefix_trie(spark.read.parquet(f"{FOLDER}/conversations.parquet"), paths_per_task=per_task)
    rows = pd.read_parquet(f"{FOLDER}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    assert _found(found) == _brute(_brute_rebuilt(rows.itertuples(index=False, name=None)))
    assert found.columns == prefix_trie.OUT


def test_odd_rows_copies_and_levels(spark, monkeypatch):
    rng = random.Random(5)
    rows = [
        (1, 0, "user", "hello"), (1, None, None, None), (1, 0, "user", "hello"), (1, 0, "bot", "a tie"),
        (2, 1, "user", ""), (None, 0, "user", "nobody's"), (7, 5, "user", "\U0001f600 é"), (-3, 0, "user", "minus"),
        (5, 0, "user", "one"), (105, 0, "user", "of an absent head"), (100_000, 1, "user", "x" * 100_000),
    ]
    for c in range(200, 500):  # many whole copies, and heads that many share
        rows += [(c, t, "user", rng.choice(["same", "same", "same", "other"])) for t in range(4)]
    rows += [(600, t, "user", "long") for t in range(2_000)]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    monkeypatch.setattr(prefix_trie, "MERGED", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    expected = _brute(_brute_rebuilt(rows))
    assert _found(prefix_trie.prefix_trie(table, paths_per_task=12)) == expected
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0
    lost = prefix_trie.prefix_trie(spark.createDataFrame([(5, 0, "user", "one", "", "", "")], SCHEMA))
    assert _found(lost) == _brute(_brute_rebuilt([(5, 0, "user", "one")]))
