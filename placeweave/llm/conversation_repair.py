"""Repair of conversations whose turns are damaged: the cheapest edits after which the roles'
initials read (s?(ua)+)?, that is, an optional system turn and then user and assistant in turn.

Rows of a conversation are taken by turn (null first), then role, then SHA-256 of the text. A row's
first fault counts: blank (nothing but white space), duplicate (role and text occur in an earlier
row), truncated (the last character that is no white space is not one of . ! ?). Keep costs 0,
Rerole to user or assistant 3, Delete 4 and is required for blank and duplicate rows, Insert of an
empty turn 3; a truncated row that stays costs 3 more. Of edits that cost the same the one whose
initials come first in ASCII wins.

Method: Viterbi over four states (nothing yet, after system, after user, after assistant). A state's
survivor is a leaf of a backpointer tree whose nodes count their references. Losing branches are
released, and once all survivors share an ancestor, the edits up to it leave the task. So what is
held is the part on which survivors still differ, with runs of one edit as a single node. Survivors
of equal cost are compared over all edits on which they differ: two that have parted never change
their order again, so this comparison is carried on as their rank. A state is given up as soon as
another one can do whatever it might do at a lower cost, so costs stay within a few units.

The edits are found on narrow rows (keys and hashes). They are one letter a row, and meet the texts
in a second pass that streams each conversation in order. One conversation is one stream in both,
since its hash is defined over the whole of it; only the letters of its edits are held at once.

Cases: a null role or text counts as one space. A null conv_id is a conversation of its own. A role
without characters has no initial and cannot be kept. Rows of one turn are ordered as said; repeated
rows are duplicates. Gaps ignore null turns. Empty tables give none. Other columns are not read. Of
a text only its end, its hash and the text itself as it streams through are used, whole.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELABEL, REMOVE, ADD, CUT = 3, 4, 3, 3
WHITE = " \t\n\x0b\f\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
# State after one more row of that initial.
_AFTER = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
# _INSTEAD[q][p]: what it may cost at most to stand in state q and do what the best from p would do.
_INSTEAD = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
# Turns that have to be inserted at the end.
_CLOSE = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_CHUNK = 1 << 16
_ROWS, _BYTES = 2048, 4 << 20


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(turns inserted, state after them): longer insertions only lead back."""
    yield 0, state
    for n in (1, 2):
        state = ASSISTANT if state == USER else USER
        yield n, state


def _options(initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, letters) of everything that may be done about one row."""
    found = {}
    for p in range(4):
        for n, state in _inserted(p):
            ways = [(state, REMOVE, "D")]
            if not must_go:
                more = CUT if cut else 0
                ways += [(_AFTER[initial, state], more, "K")] if (initial, state) in _AFTER else []
                ways += [(_AFTER[role, state], RELABEL + more, "R") for role in "ua" if (role, state) in _AFTER]
            for q, cost, letter in ways:
                way = (n * ADD + cost, "I" * n + letter)
                found[p, q] = min(found.get((p, q), way), way)
    return [(p, q, *way) for (p, q), way in found.items()]


class _Node:
    """So many equal steps of a path, after those of `parent`."""

    __slots__ = ("letters", "parent", "refs", "times")

    def __init__(self, parent, letters):
        self.parent, self.letters, self.times, self.refs = parent, letters, 1, 1


class Survivors:
    """The best path to each state, over the rows fed so far. `out` gets edits that are settled."""

    _options: dict = {}
    _steps: dict = {}

    def __init__(self, out):
        self.out, self.spent = out, 0
        self.costs, self.ranks = (0, _FAR, _FAR, _FAR), (0, 0, 0, 0)
        self.root = _Node(None, "")
        self.leaves = [self.root, None, None, None]

    @classmethod
    def _step(cls, costs, ranks, kind):
        """What a row does to costs and ranks, and which survivor each new one extends. The costs
        stay within a few units, so there are few such steps, and each is worked out once."""
        key = (costs, ranks, kind)
        if key not in cls._steps:
            if kind not in cls._options:
                cls._options[kind] = _options(*kind)
            best = {}
            for p, q, cost, letters in cls._options[kind]:
                if costs[p] < _FAR:
                    way = (costs[p] + cost, ranks[p], letters, p)
                    best[q] = min(best.get(q, way), way)
            alive = {q: w for q, w in best.items() if all(w[0] <= v[0] + _INSTEAD[o][q] for o, v in best.items())}
            order = {q: k for k, q in enumerate(sorted(alive, key=lambda q: alive[q][1:3]))}
            low = min(w[0] for w in alive.values())
            cls._steps[key] = (
                tuple(alive[q][0] - low if q in alive else _FAR for q in range(4)),
                tuple(order.get(q, 0) for q in range(4)), low, [(q, w[3], w[2]) for q, w in alive.items()])
        return cls._steps[key]

    def feed(self, initial: str, must_go: bool, cut: bool) -> None:
        self.costs, self.ranks, low, moves = self._step(self.costs, self.ranks, (initial, must_go, cut))
        self.spent += low
        heirs = [0, 0, 0, 0]
        for _, p, _ in moves:
            heirs[p] += 1
        leaves = [None, None, None, None]
        for q, p, letters in moves:
            leaf = self.leaves[p]
            if heirs[p] == 1 and leaf.refs == 1 and leaf.letters == letters and leaf is not self.root:
                leaf.times += 1
                leaves[q] = leaf
            else:
                leaves[q] = _Node(leaf, letters)
                leaf.refs += 1
        for leaf in self.leaves:
            if leaf is not None and leaf not in leaves:
                self._release(leaf)
        self.leaves = leaves
        if self.root.refs == 1:
            self._settle()

    def _release(self, node) -> None:
        """One reference less; a node without any goes, and its parent has one less."""
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def _path(self, leaf) -> list:
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        return path[::-1]

    def _settle(self) -> None:
        """Give out what all survivors have in common."""
        for node in self._path(next(x for x in self.leaves if x is not None)):
            if self.root.refs != 1 or self.root in self.leaves:
                break
            self.out(node.letters, node.times)
            node.parent, self.root = None, node

    def held(self) -> int:
        """Nodes of the tree."""
        return len({id(n) for leaf in self.leaves if leaf is not None for n in self._path(leaf)})

    def close(self) -> int:
        """End the conversation: the cheapest path goes out; its cost is returned."""
        ends = [(self.costs[s] + _CLOSE[s] * ADD, self.ranks[s], s) for s in range(4) if self.costs[s] < _FAR]
        cost, _, state = min(ends)
        for node in self._path(self.leaves[state]):
            self.out(node.letters, node.times)
        if _CLOSE[state]:
            self.out("I" * _CLOSE[state], 1)
        return self.spent + cost


def _rows(batches, columns: int):
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(columns)], strict=True)


_NONE = object()


def _find_edits(batches):
    """Rows in order to pieces of (edits, faults) of each conversation: the letters of Insert stand
    before the letter of the row they precede; a fault is one letter a row, or a dot."""
    done = []
    letters, faults = [], []
    size = part = 0
    conv, last, path = _NONE, None, None

    def out(text, times):
        nonlocal size
        letters.append(text * times)
        size += len(text) * times

    def cut():
        nonlocal size, part
        done.append((conv, part, "".join(letters), "".join(faults)))
        letters.clear()
        faults.clear()
        size, part = 0, part + 1

    def batch():
        made = pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2] for d in done], pa.string()), pa.array([d[3] for d in done], pa.string())],
            names=["conv_id", "part", "edits", "faults"])
        done.clear()
        return made

    for c, turn, role, digest, blank, truncated, later in _rows(batches, 7):
        if conv is _NONE or c != conv:
            if conv is not _NONE:
                path.close()
                cut()
            conv, last, part, path = c, None, 0, Survivors(out)
            if len(done) >= _ROWS:
                yield batch()
        key = (turn, role, digest)
        duplicate = not blank and (later or key == last)
        last = key
        faults.append("b" if blank else "d" if duplicate else "t" if truncated else ".")
        path.feed(role[:1] if role[:1] in ("s", "u", "a") else "", blank or duplicate, truncated)
        if size + len(faults) >= _CHUNK:
            cut()
            if len(done) >= 64:
                yield batch()
    if conv is not _NONE:
        path.close()
        cut()
    if done:
        yield batch()


_FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated", ".": None}
_REPAIRED = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("cost", pa.int32()), ("fault", pa.string()),
    ("turn", pa.int64()), ("role_before", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply_edits(batches):
    """Pieces of edits and then the rows of each conversation, to repaired rows."""
    made, size = [], 0
    conv, edits, faults, at, row, state, place = _NONE, [], [], 0, 0, EMPTY, 0

    def batch():
        columns = list(zip(*made, strict=True))
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED, strict=True)], schema=_REPAIRED)

    def add(edit, cost, fault, turn, before, initial, role, text):
        nonlocal state, place
        if role is not None:
            state = _AFTER[initial, state]
        made.append((conv, place, edit, cost, fault, turn, before, role, text))
        place += 1

    def insert(all_of, until):
        nonlocal at
        while at < until and all_of[at] == "I":
            role = "assistant" if state == USER else "user"
            add("I", ADD, None, None, None, role[0], role, "")
            at += 1

    for c, kind, turn, role, text, found, faulty in _rows(batches, 7):
        if conv is _NONE or c != conv:
            if conv is not _NONE:
                insert(edits, len(edits))
            conv, edits, faults, at, row, state, place = c, "", "", 0, 0, EMPTY, 0
        if kind == 0:
            edits, faults = edits + found, faults + faulty
            continue
        insert(edits, len(edits))
        edit, fault = edits[at], _FAULTS[faults[row]]
        at, row = at + 1, row + 1
        more = CUT if fault == "truncated" else 0
        if edit == "D":
            add("D", REMOVE, fault, turn, role, None, None, None)
        elif edit == "K":
            add("K", more, fault, turn, role, role[0], role, text)
        else:
            to = "assistant" if state == USER else "user"
            add("R", RELABEL + more, fault, turn, role, to[0], to, text)
        size += len(text)
        if len(made) >= _ROWS or size >= _BYTES:
            yield batch()
            size = 0
    if conv is not _NONE:
        insert(edits, len(edits))
    if made:
        yield batch()


def _keyed(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def find_edits(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, edits, faults): each conversation's edits and faults as letters, in pieces."""
    end = F.rtrim("text", F.lit(WHITE))
    narrow = _keyed(conversations).select(
        "conv_id", "turn", "role", "digest", (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    repeated = narrow.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(
        first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = narrow.join(repeated, same, "left").select(
        "conv_id", "turn", "role", "digest", "blank", "truncated", later.alias("later"))
    order = ["conv_id", "turn", "role", "digest"]
    return marked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _find_edits, "conv_id long, part long, edits string, faults string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit: conv_id, position (from 0), edit (K, R, D or I), its cost, the fault, turn
    and role of the row before, and role and text after (null where the row goes). Rows of a
    conversation stand together and in order, which `digests` relies on."""
    edits = find_edits(conversations).select(
        "conv_id", F.lit(0).alias("kind"), "part", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "edits", "faults")
    rows = _keyed(conversations).select(
        "conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), "turn", "role", "digest", "text",
        F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("faults"))
    dealt = edits.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "part", "turn", "role", "digest")
    return dealt.select("conv_id", "kind", "turn", "role", "text", "edits", "faults").mapInArrow(
        _apply_edits, "conv_id long, position long, edit string, cost int, fault string, turn long, "
                      "role_before string, role string, text string")


_DIGEST = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_LEGAL = ("su", "ua", "au")


def _fold(batches):
    """Repaired rows in order to one row per conversation."""
    conv, made = _NONE, []

    def end():
        gaps = high - low + 1 - distinct if distinct else 0
        made.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))

    def batch():
        columns = list(zip(*made, strict=True))
        made.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if k >= 7 else pa.int64()) for k, c in enumerate(columns)], names=list(_DIGEST))

    for c, edit, spent, fault, turn, before, role, text in _rows(batches, 8):
        if conv is _NONE or c != conv:
            if conv is not _NONE:
                end()
                if len(made) >= _ROWS:
                    yield batch()
            conv, audit, digest, cost, illegal, joined = c, [], hashlib.sha256(), 0, 0, False
            counts = {"blank": 0, "duplicate": 0, "truncated": 0}
            low = high = last = initial = None
            distinct = 0
        audit.append(edit)
        cost += spent
        if fault:
            counts[fault] += 1
        if before is not None:
            illegal += initial is not None and initial + before[:1] not in _LEGAL
            initial = before[:1]
            if turn is not None:
                distinct += turn != last
                last, high = turn, turn
                low = turn if low is None else low
        if role is not None:
            digest.update((("\n" if joined else "") + role + ":" + text).encode())
            joined = True
    if conv is not _NONE:
        end()
    if made:
        yield batch()


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation that has rows: gaps in its turns, faults, illegal neighbours, cost and letters
    of the edits, SHA-256 of the repaired turns (role:text, joined by line breaks)."""
    return repaired.select("conv_id", "edit", "cost", "fault", "turn", "role_before", "role", "text").mapInArrow(
        _fold, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "audit string, repaired_sha256 string")


def with_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """`digests` for every conv_id of a table; one without rows has zeros and the hash of nothing."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    rest = {"audit": F.lit(""), "repaired_sha256": F.lit(nothing)}
    return ids.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *[F.coalesce(n, rest.get(n, F.lit(0))).alias(n) for n in _DIGEST[1:]])
