"""Prefix trie of conversations: who shares which first turns, and what storing them once saves.

A node is a distinct sequence of first turns (role and text). Its name is a hash of the sequence, to
which the names of its turns add up (a polynomial modulo 2^127 - 1), so that names of a conversation
that several tasks share are put together from their parts. Sequences come from one sort by
conversation and turn, over ranges that may cut a conversation anywhere; only the hash and length of
each part of a cut conversation come to the driver, two for each task boundary at most.

Method: each task inserts its sequences, in batches, into a z-fast trie. That is a compacted trie, in
which a node stands for the edge that leads to it, and a table that finds a node by the name of its
path at the handle depth, the number on the edge that is divisible by the highest power of two. A
sequence finds where it leaves the trie by a fat binary search of that table, in as many look-ups as
its length has binary digits, and a search of the last edge; it then ends there, splits the edge, or
grows a leaf. When a batch is full, its edges are expanded to one row per node with what the task
knows of it, so a first turn that a third of all conversations share leaves a task as one row per
batch. Spark adds these rows up by name. Sums over subtrees take a second pass of the same kind:
every node's own value rests with the conversation of its smallest member, is summed from the leaves
up within a batch, and is added up by name.

A batch has at most BATCH turns and a sequence at most BLOCK of them; what goes on after it is a
sequence below the name where it was cut. No conversation, group of copies or first turn is gathered.

Cases: a null role or text counts as empty. Rows without conv_id belong to no conversation and are
left out. Rows of one turn are ordered by the hash of role and text; repeated rows are turns of their
own. Conversations without turns end at the root. An empty table has no nodes. Texts count by their
hash and length alone, in whole. Other columns are not read.
"""

import hashlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import written

MODULUS = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"turn").digest()[:15], "big") | 1
ROOT = int.from_bytes(hashlib.sha256(b"no turns").digest()[:15], "big")
BATCH, BLOCK = 100_000, 4096
# Conversations whose ids differ in the last digits only are joined to one piece of a list.
_IDS = 1024
_ROWS = 8192


def _name(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _rows(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batch(made: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True))
    made.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, chars): the hash of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("key"), F.length(text).cast("long").alias("chars"))


_LOCAL = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("local", pa.binary()),
                    ("key", pa.binary()), ("chars", pa.int64()), ("tail", pa.bool_())])


def _run_along(batches):
    """Place and name within the part of a conversation that this task holds."""
    part, made, held, conv, at, value = TaskContext.get().partitionId(), [], None, None, 0, 0
    for c, key, chars in _rows(batches):
        if held is not None:
            made.append((*held, c != conv))
            if len(made) >= _ROWS:
                yield _batch(made, _LOCAL)
        if held is None or c != conv:
            conv, at, value = c, 0, 0
        at, value = at + 1, (value * BASE + int.from_bytes(key, "big")) % MODULUS
        held = (c, part, at, _name(value), key, chars)
    if held is not None:
        made.append((*held, True))
        yield _batch(made, _LOCAL)


_SEQUENCE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("name", pa.binary()), ("above", pa.binary()),
                       ("key", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])


def sequences(keyed: DataFrame, order: str) -> DataFrame:
    """(conv_id, depth, name, above, key, chars, last): turns numbered from 1, with the names of the
    node that each leads to and of the one above, written to the shared folder in order."""
    sort = ["conv_id", order, "key"]
    dealt = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("conv_id", "key", "chars")
    local = written(dealt.mapInArrow(_run_along, "conv_id long, part int, at long, local binary, key binary, chars long, tail boolean"), "runs")
    # A boundary between tasks cuts one conversation at most: two rows for each.
    parts = local.filter("tail").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("part", "at", "local"))).alias("parts")).filter("n > 1")
    before, goes_on = {}, set()
    for row in parts.select("conv_id", "parts").collect():
        depth, value = 0, ROOT
        for k, p in enumerate(row["parts"]):
            before[row["conv_id"], p["part"]] = depth, value
            depth, value = depth + p["at"], (value * pow(BASE, p["at"], MODULUS) + int.from_bytes(p["local"], "big")) % MODULUS
            if k + 1 < len(row["parts"]):
                goes_on.add((row["conv_id"], p["part"]))
    shared = keyed.sparkSession.sparkContext.broadcast((before, goes_on))

    def whole(batches):
        before, goes_on = shared.value
        made = []
        for c, part, at, value, key, chars, tail in _rows(batches):
            depth, start = before.get((c, part), (0, ROOT))
            power, value = pow(BASE, at - 1, MODULUS), int.from_bytes(value, "big")
            # The value above is this one without its own turn.
            above = (start * power + (value - int.from_bytes(key, "big")) * _UNBASE) % MODULUS
            value = (start * power * BASE + value) % MODULUS
            made.append((c, depth + at, _name(value), _name(above), key, chars, tail and (c, part) not in goes_on))
            if len(made) >= _ROWS:
                yield _batch(made, _SEQUENCE)
        if made:
            yield _batch(made, _SEQUENCE)

    return local.mapInArrow(whole, "conv_id long, depth long, name binary, above binary, key binary, chars long, last boolean")


_UNBASE = pow(BASE, -1, MODULUS)


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Run:
    """Consecutive turns of a conversation: names[k] is the node at depth `base` + k, and facts[k]
    what is known of it."""

    __slots__ = ("base", "conv", "facts", "names")

    def __init__(self, conv, base, above):
        self.conv, self.base, self.names, self.facts = conv, base, [above], [None]


class _Node:
    """The end of a compacted edge: depths from `top` (not included) to `depth`, spelt by `run`."""

    __slots__ = ("children", "depth", "low", "parent", "run", "runs", "top")

    def __init__(self, parent, top, depth, run):
        self.parent, self.top, self.depth, self.run = parent, top, depth, run
        self.children, self.runs, self.low = {}, 0, None

    def name(self, depth: int) -> bytes:
        return self.run.names[depth - self.run.base]


class ZFastTrie:
    """Tries of runs, one below each name where runs begin."""

    def __init__(self):
        self.below, self.turns, self.probes = {}, 0, 0

    def insert(self, run: _Run) -> None:
        base, end, names = run.base, run.base + len(run.names) - 1, run.names
        if names[0] not in self.below:
            self.below[names[0]] = _Node(None, base, base, run), {}
        root, handles = self.below[names[0]]
        self.turns += end - base
        node, onward = self._exit(root, handles, run, end)
        if onward is not None:
            depth = self._shared(onward, run, node.depth + 1, min(onward.depth, end))
            node = onward if depth == onward.depth else self._split(handles, onward, depth)
        if node.depth < end:
            leaf = _Node(node, node.depth, end, run)
            node.children[names[node.depth + 1 - base]] = leaf
            handles[leaf.name(fattest(leaf.top, end))] = leaf
            node = leaf
        node.runs += 1
        node.low = run.conv if node.low is None else min(node.low, run.conv)

    def _exit(self, root, handles, run, end):
        """The last node whose path the run spells, and the child on whose edge the run goes on."""
        node, low, high = root, root.depth, end
        while low < high:
            at = fattest(low, high)
            self.probes += 1
            found = handles.get(run.names[at - run.base])
            if found is None:
                high = at - 1
            elif found.depth <= end and found.name(found.depth) == run.names[found.depth - run.base]:
                node, low = found, found.depth
            else:
                return found.parent, found
        return node, node.children.get(run.names[low + 1 - run.base]) if low < end else None

    @staticmethod
    def _shared(node, run, low, high) -> int:
        """The last depth from `low` on at which an edge and a run that share `low` agree."""
        while low < high:
            at = (low + high + 1) // 2
            if node.name(at) == run.names[at - run.base]:
                low = at
            else:
                high = at - 1
        return low

    @staticmethod
    def _split(handles, node, depth):
        del handles[node.name(fattest(node.top, node.depth))]
        middle = _Node(node.parent, node.top, depth, node.run)
        node.parent.children[node.name(node.top + 1)] = middle
        middle.children[node.name(depth + 1)] = node
        node.parent, node.top = middle, depth
        handles[middle.name(fattest(middle.top, depth))] = middle
        handles[node.name(fattest(depth, node.depth))] = node
        return middle

    def from_below(self):
        """All nodes but the roots, children before their parents."""
        for root, _ in self.below.values():
            order, todo = [], list(root.children.values())
            while todo:
                node = todo.pop()
                order.append(node)
                todo += node.children.values()
            yield from reversed(order)


def _runs(rows, block: int):
    """Runs of consecutive turns. A row is (conv_id, depth, name, above, fact)."""
    run = None
    for conv, depth, name, above, fact in rows:
        if run is not None and (run.conv != conv or depth != run.base + len(run.names) or len(run.names) > block):
            yield run
            run = None
        if run is None:
            run = _Run(conv, depth - 1, above)
        run.names.append(name)
        run.facts.append(fact)
    if run is not None:
        yield run


def _in_batches(runs, expand, schema, batch: int):
    """Insert runs until a trie is full, and expand its edges to rows."""
    trie, made = ZFastTrie(), []
    for run in runs:
        trie.insert(run)
        if trie.turns >= batch:
            for row in expand(trie):
                made.append(row)
                if len(made) >= _ROWS:
                    yield _batch(made, schema)
            trie = ZFastTrie()
    for row in expand(trie):
        made.append(row)
        if len(made) >= _ROWS:
            yield _batch(made, schema)
    if made:
        yield _batch(made, schema)


_COUNTS = pa.schema([("name", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()),
                     ("conv_id", pa.int64()), ("n", pa.int64())])


def _members(trie: ZFastTrie):
    """One row per node of a batch: how many members it has there, and the smallest."""
    for node in trie.from_below():
        for child in node.children.values():
            node.runs += child.runs
            node.low = child.low if node.low is None else min(node.low, child.low)
        base, run = node.run.base, node.run
        for d in range(node.top + 1, node.depth + 1):
            yield run.names[d - base], run.names[d - base - 1], d, run.facts[d - base], node.low, node.runs


def _count_members(batches, block: int, batch: int):
    return _in_batches(_runs(_rows(batches), block), _members, _COUNTS, batch)


_SUMS = pa.schema([("name", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])


def _with_values(rows):
    """Turns with the values of their nodes, which follow a turn as rows without a name."""
    turn, saved, leaves = None, 0, 0
    for conv, depth, name, above, more, ends in rows:
        if name is None:
            saved, leaves = saved + more, leaves + ends
            continue
        if turn is not None:
            yield (*turn, (saved, leaves))
        turn, saved, leaves = (conv, depth, name, above), 0, 0
    if turn is not None:
        yield (*turn, (saved, leaves))


def _sum_subtrees(batches, block: int, batch: int):
    own = {}

    def valued():
        for run in _runs(_with_values(_rows(batches)), block):
            found = [(n, f) for n, f in zip(run.names[1:], run.facts[1:], strict=True) if f != (0, 0)]
            for name, (saved, leaves) in found:
                had = own.get(name, (0, 0))
                own[name] = had[0] + saved, had[1] + leaves
            if found:
                yield run

    def subtrees(trie):
        below = {}
        for node in trie.from_below():
            saved, leaves = below.pop(id(node), (0, 0))
            base, names = node.run.base, node.run.names
            for d in range(node.depth, node.top, -1):
                more = own.pop(names[d - base], (0, 0))
                saved, leaves = saved + more[0], leaves + more[1]
                yield names[d - base], saved, leaves
            had = below.get(id(node.parent), (0, 0))
            below[id(node.parent)] = had[0] + saved, had[1] + leaves

    return _in_batches(valued(), subtrees, _SUMS, batch)


def _subtree_sums(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, saved, leaves) of every node but the root. A node's own value rests with the turn of its
    smallest member, and the values below a block with its last turn."""
    own = nodes.select("conv_id", "depth", F.col("weight").alias("saved"), F.col("leaf").alias("leaves"))
    block = F.floor((F.col("depth") - 1) / BLOCK)
    deep = own.filter(F.col("depth") > BLOCK).groupBy("conv_id", block.alias("block")).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    onward = Window.partitionBy("conv_id").orderBy(F.col("block").desc())
    there = found.filter(F.col("depth") > BLOCK).select("conv_id", block.alias("block")).distinct()
    carried = there.join(deep, ["conv_id", "block"], "left").select(
        "conv_id", (F.col("block") * BLOCK).alias("depth"), F.coalesce(F.sum("saved").over(onward), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves").over(onward), F.lit(0)).alias("leaves"))
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("name", "above")]
    turns = found.select("conv_id", "depth", "name", "above", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"), F.lit(0).alias("kind"))
    values = own.unionByName(carried).select("conv_id", "depth", *nothing, "saved", "leaves", F.lit(1).alias("kind"))
    dealt = turns.unionByName(values).withColumn("block", block).repartition("conv_id", "block").sortWithinPartitions("conv_id", "depth", "kind")
    sums = dealt.select("conv_id", "depth", "name", "above", "saved", "leaves").mapInArrow(
        partial(_sum_subtrees, block=BLOCK, batch=BATCH), "name binary, saved long, leaves long")
    return sums.groupBy("name").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


_ENDS = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _hash_ends(batches):
    """Pieces of lists in order to the hash of each node's list."""
    made, name, digest = [], None, None
    for n, piece in _rows(batches):
        if n == name:
            digest.update(b",")
        else:
            if name is not None:
                made.append((name, digest.hexdigest()))
                if len(made) >= _ROWS:
                    yield _batch(made, _ENDS)
            name, digest = n, hashlib.sha256()
        digest.update(piece.encode())
    if name is not None:
        made.append((name, digest.hexdigest()))
        yield _batch(made, _ENDS)


def _ends(found: DataFrame, without: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations end. Ids are joined to pieces of at most
    _IDS of them, so that a task hashes few rows for a node where many end."""
    ends = found.filter("last").select("name", "conv_id").unionByName(without.select(F.lit(bytearray(_name(ROOT))).alias("name"), "conv_id"))
    pieces = ends.groupBy("name", F.floor(F.col("conv_id") / _IDS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(
        _hash_ends, "name binary, ends_sha256 string")


def prefix_trie(keyed: DataFrame, order: str = "turn", conversations: DataFrame | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points) and ends_sha256. `keyed` are turns as `turn_keys` makes them;
    `conversations` (conv_id) may name some that have none."""
    found = written(sequences(keyed, order), "sequences")
    ids = (keyed if conversations is None else conversations).filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    without = ids.join(found.filter("last").select("conv_id"), "conv_id", "left_anti")
    counted = found.select("conv_id", "depth", "name", "above", "chars").mapInArrow(
        partial(_count_members, block=BLOCK, batch=BATCH), "name binary, above binary, depth long, chars long, conv_id long, n long")
    nodes = counted.groupBy("name", "above", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(bytearray(_name(ROOT))).alias("name"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("above").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "name", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")), "leaf": F.col("n_children").isNull().cast("long"),
        "weight": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    below = nodes.filter("depth > 0")
    whole = nodes.agg(F.sum("weight").alias("saved"), F.sum("leaf").alias("leaves")).select(
        F.lit(bytearray(_name(ROOT))).alias("name"), "saved", "leaves")
    sums = _subtree_sums(found, below).unionByName(whole)
    parents = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    nobody = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, "name").join(_ends(found, without), "name", "left").join(parents, "above", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
    )
