"""Prefix trie of conversations by union-find over sorted neighbours.

Every conversation is a path of turn digests. Paths are dealt by ranges and sorted, so those with a common prefix are
neighbours, and the longest common prefix (LCP) of two neighbours is an edge between them. A task takes its edges in
descending depth; each merge of two components makes a branching node (or joins one at that depth), which leaves the
compact trie of the task's paths. Nodes that are a prefix of the first or last path may go on in another task: they
stay open and are handed on as a contracted forest, everything that hangs from them summed up. Forests of neighbouring
tasks are merged by the same procedure until one is left; nodes between two compact ones are written out on the way.
"""

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ebbtide.llm.tables import with_size_checked
from ebbtide.session import materialized

#: Bytes of a turn's digest.
STEP = 16
#: Conversations whose paths one task holds, on average.
PATHS = 20_000
#: Forests of neighbouring tasks that are merged at a time.
MERGED = 32
#: Ids that are hashed as one string where the members of an open node are written.
CHUNK_IDS = 500
HEADS_OF = 100
HEADS = 6

NODE, OPEN, ENDS = 0, 1, 2
#: Rows that tasks hand on, of three kinds.
ROW = [
    ("kind", pa.int32()), ("part", pa.int32()),
    # a node: key is set where other rows may refer to it, parent_key where its parent is still open
    ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    # an open node: what has been closed below it
    ("path", pa.binary()), ("chars", pa.list_(pa.int64())), ("ends", pa.bool_()), ("first", pa.bool_()),
    ("last", pa.bool_()),
    # members of an open node that end there
    ("chunk", pa.int32()), ("ids", pa.string()),
]
_ARROW = pa.schema(ROW)
_SPARK = from_arrow_schema(_ARROW)


@dataclass
class Item:
    """A path that reaches its last turn with what is known to lie at and below it."""

    path: bytes
    chars: list
    n: int = 0
    smallest: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bool = False
    ids: list = field(default_factory=list)


@dataclass
class Node:
    depth: int
    item: Item  # whose path leads here
    items: list
    below: list
    n: int = 0
    smallest: int | None = None
    leaves: int = 0
    saved: int = 0
    closed: int = 0  # children already written
    ends: bool = False

    @property
    def path(self):
        return self.item.path[: STEP * self.depth]


def common_depth(a: bytes, b: bytes) -> int:
    """Turns at the start of both paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    low, high = 0, n // STEP  # the first ``low`` agree, the first ``high`` do not
    while high - low > 1:
        mid = (low + high) // 2
        if a[STEP * low : STEP * mid] == b[STEP * low : STEP * mid]:
            low = mid
        else:
            high = mid
    return low


def compact_trie(items: list[Item]) -> Node:
    """Root of the compact trie of ``items``, which are sorted by path and begin with an empty path."""
    owner = list(range(len(items)))
    top = [Node(len(item.path) // STEP, item, [item], []) for item in items]
    edges = [common_depth(a.path, b.path) for a, b in zip(items, items[1:])]

    def find(i):
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(len(edges)), key=lambda e: -edges[e]):
        left, right, depth = find(i), find(i + 1), edges[i]
        a, b = top[left], top[right]
        if a.depth == depth == b.depth:
            if len(a.items) + len(a.below) < len(b.items) + len(b.below):
                a, b = b, a
            a.items += b.items
            a.below += b.below
            merged = a
        elif a.depth == depth:
            a.below.append(b)
            merged = a
        elif b.depth == depth:
            b.below.append(a)
            merged = b
        else:
            merged = Node(depth, a.item, [], [a, b])
        owner[right] = left
        top[left] = merged
    return top[find(0)]


def _chain(node, above):
    """Worth of the turns between ``node`` and the node at depth ``above``, without both."""
    return (node.n - 1) * sum(node.item.chars[above : node.depth - 1])


def _sum_up(root):
    """Fill in what lies at and below every node; nodes in an order in which parents come first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.below
    for node in reversed(order):
        parts = [*node.items, *node.below]
        node.n = sum(p.n for p in parts)
        node.smallest = min((p.smallest for p in parts if p.smallest is not None), default=None)
        node.closed = sum(i.children for i in node.items)
        node.ends = any(i.ends for i in node.items)
        own = (node.n - 1) * node.item.chars[node.depth - 1] if node.depth else 0
        node.saved = own + sum(i.saved for i in node.items) + sum(c.saved + _chain(c, node.depth) for c in node.below)
        node.leaves = sum(p.leaves for p in parts) if node.below or node.closed else 1
    return order


def _key(node):
    return hashlib.blake2b(node.path, digest_size=STEP).digest()


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


NO_ENDS = _sha("")


def forest(items: list[Item], part: int, first: bytes | None, last: bytes | None, referred: bool):
    """Rows for the closed nodes of ``items`` and the open nodes with the ids that end there.

    ``first`` and ``last``: paths along which nodes stay open (None: everything is closed). ``referred``: nodes may have
    been open before, so others refer to them by key.
    """
    root = compact_trie(items)
    order = _sum_up(root)
    is_open = set()
    if first is not None:
        stack = [root]
        while stack:
            node = stack.pop()
            if first.startswith(node.path) or last.startswith(node.path):
                is_open.add(id(node))
                stack += node.below
    above = {id(child): node for node in order for child in node.below}
    rows = []
    for node in order:
        ids = sorted(i for item in node.items for i in item.ids)
        if id(node) in is_open:
            shut = [c for c in node.below if id(c) not in is_open]
            path = node.path
            rows.append(
                {
                    "kind": OPEN,
                    "part": part,
                    "path": path,
                    "chars": node.item.chars[: node.depth],
                    "conv_id": min((p.smallest for p in [*node.items, *shut] if p.smallest is not None), default=None),
                    "n_convs": sum(p.n for p in [*node.items, *shut]),
                    "n_children": node.closed + len(shut),
                    "n_leaves": sum(p.leaves for p in [*node.items, *shut]),
                    "saved_tokens": sum(i.saved for i in node.items)
                    + sum(c.saved + _chain(c, node.depth) for c in shut),
                    "ends": node.ends or bool(ids),
                    "first": path == first,
                    "last": path == last,
                }
            )
            for k in range(0, len(ids), CHUNK_IDS):
                text = ",".join(map(str, ids[k : k + CHUNK_IDS]))
                rows.append({"kind": ENDS, "part": part, "key": _key(node), "chunk": k // CHUNK_IDS, "ids": text})
            continue
        parent = above.get(id(node))
        stop = parent.depth if parent else -1
        saved = node.saved
        for depth in range(node.depth, stop, -1):
            is_last = depth == node.depth
            if not is_last:
                saved += (node.n - 1) * node.item.chars[depth - 1]
            pending = parent is not None and depth == stop + 1 and id(parent) in is_open
            if depth > stop + 1:
                parent_conv = node.smallest
            else:
                parent_conv = None if parent is None or pending else parent.smallest
            rows.append(
                {
                    "kind": NODE,
                    "part": part,
                    "key": _key(node) if referred and is_last else None,
                    "parent_key": _key(parent) if pending else None,
                    "conv_id": node.smallest,
                    "depth": depth,
                    "parent_conv_id": parent_conv,
                    "n_convs": node.n,
                    "n_children": len(node.below) + node.closed if is_last else 1,
                    "n_leaves": node.leaves,
                    "saved_tokens": saved,
                    # null: to be made of the ids that were written while the node was open
                    "ends_sha256": (_sha(",".join(map(str, ids))) if not node.ends else None) if is_last else NO_ENDS,
                }
            )
    return rows


def _batches(rows, size=5_000):
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[k : k + size], _ARROW)


def _first_forests(paths: DataFrame, n_parts) -> DataFrame:
    def build(batches):
        from pyspark import TaskContext

        items = [Item(b"", [])]
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "path", "chars"))
            items += [Item(p, c, 1, i, ids=[i]) for i, p, c in zip(*columns)]
        if len(items) > 1:
            part = TaskContext.get().partitionId()
            yield from _batches(forest(items, part, items[1].path, items[-1].path, referred=False))

    dealt = paths.select("conv_id", "path", "chars").repartitionByRange(n_parts, "path", "conv_id")
    return dealt.sortWithinPartitions("path", "conv_id").mapInArrow(build, _SPARK)


def _merged_forests(opened: DataFrame, is_final) -> DataFrame:
    """Forests of up to ``MERGED`` neighbouring parts as one."""

    def merge(key, table):
        found = table.to_pylist()
        items = [Item(b"", [])]
        for r in sorted(found, key=lambda r: (r["path"], r["part"])):
            known = (r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"])
            items.append(Item(r["path"], r["chars"], *known))
        first = last = None
        if not is_final:
            first = min((r["part"], r["path"]) for r in found if r["first"])[1]
            last = max((r["part"], r["path"]) for r in found if r["last"])[1]
        rows = forest(items, key[0].as_py(), first, last, referred=True)
        return pa.Table.from_batches(_batches(rows), _ARROW)

    group = F.floor(F.col("part") / MERGED).cast("int").alias("group")
    return opened.groupBy(group).applyInArrow(merge, _SPARK)


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the ids of each key, ascending, through SHA-256; a key's ids are read, never held."""
    hashed = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(key=k, ends_sha256=s) for k, s in done], hashed)
        if state:
            yield pa.RecordBatch.from_pylist([dict(key=key, ends_sha256=state.hexdigest())], hashed)

    dealt = chunks.select("key", "part", "chunk", "ids").repartition("key").sortWithinPartitions("key", "part", "chunk")
    return dealt.mapInArrow(run, from_arrow_schema(hashed))


def rebuilt(conversations: DataFrame, heads_of=HEADS_OF, heads=HEADS) -> DataFrame:
    """``conv_id, path, chars``: turns of every conversation behind a head shared with others.

    Conversation c starts with the first h turns of conversation c - c % ``heads_of`` (h: CRC-32 of decimal c modulo
    ``heads``; all if it has fewer, none if it is absent) and goes on with its own turns behind its first h. ``path`` has
    16 bytes for each turn (MD5 of role and text), ``chars`` its code points. Texts are not moved, their digests are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("has_place"),
            F.col("turn").alias("place"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            F.length(text).cast("long").alias("chars"),
        ).alias("turn"),
    )
    in_order = F.array_sort(F.collect_list("turn"))
    own = materialized(turns.groupBy("conv_id").agg(in_order.alias("turns")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % heads_of
    shared = own.where(F.col("conv_id") % heads_of == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumns({"base": base, "h": h}).join(shared, "base", "left")
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    turns = F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))"))
    joined = joined.select("conv_id", turns.alias("turns"))
    return joined.select(
        "conv_id",
        F.expr("unhex(array_join(transform(turns, t -> t.digest), ''))").alias("path"),
        F.expr("transform(turns, t -> t.chars)").alias("chars"),
    )


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, paths_per_task=PATHS) -> DataFrame:
    """A row for every distinct prefix of the paths, from the root (depth 0), as ``prefix_trie`` returns it."""
    paths = materialized(paths, "paths")
    spark = paths.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), paths.count() // paths_per_task)
    written = [materialized(_first_forests(paths, n_parts), "forest")]
    while True:
        n_parts = -(-n_parts // MERGED)
        opened = written[-1].where(F.col("kind") == OPEN)
        written.append(materialized(_merged_forests(opened, n_parts == 1), "forest"))
        if n_parts == 1:
            break
    ends = materialized(_hashed_ends(written[0].where(F.col("kind") == ENDS)), "ends")
    closed = [w.where(F.col("kind") == NODE) for w in written]
    late = closed[1]
    for more in closed[2:]:
        late = late.unionByName(more)
    # Nodes that were open at first: some for each task, not for each conversation.
    late = materialized(
        late.join(ends.withColumnRenamed("ends_sha256", "_late"), "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", "_late", F.lit(NO_ENDS)))
        .drop("_late"),
        "late",
    )
    known = with_size_checked(late.where("key is not null").select("key", F.col("conv_id").alias("above")))
    every = closed[0].select("parent_key", *OUT).unionByName(late.select("parent_key", *OUT))
    waiting = every.where("parent_key is not null").join(known, F.col("parent_key") == F.col("key"))
    waiting = waiting.withColumn("parent_conv_id", F.col("above")).select(*OUT)
    return every.where("parent_key is null").select(*OUT).unionByName(waiting)


def prefix_trie(conversations: DataFrame, heads_of=HEADS_OF, heads=HEADS, paths_per_task=PATHS) -> DataFrame:
    """The trie of all rebuilt conversations: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256`` for every node.

    Reads ``conv_id, turn, role, text``; other columns may have any name. Turns are ordered by ``turn``, null first;
    ties by the digest of role and text, and repeated rows are turns of their own. A null role or text is empty; rows
    without a conv_id belong to no conversation. An empty table gives no rows. A conversation's digests (24 bytes a turn,
    not its texts) are one row, so its length is bounded by what a row holds; conversations that agree are split over
    tasks, and the ids that end at one node are streamed through its hash in pieces.
    """
    return trie(rebuilt(conversations, heads_of, heads), paths_per_task)
