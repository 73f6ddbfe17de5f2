"""Repair and tries of conversations against plain versions, and the rows that they must bear."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeweave.llm import conversation_repair as R
from placeweave.llm import conversation_trie as P
from placeweave.llm import q_conversations as Q

SCHEMA = "conv_id long, turn long, role string, text string"


# --- repair ---------------------------------------------------------------------------------

def cheapest(rows):
    """(cost, letters) by trying everything: rows are (initial, must go, truncated)."""
    found = []

    def go(i, roles, cost, letters, added):
        legal = "".join(roles).removeprefix("s")
        if legal != ("ua" * len(legal))[:len(legal)]:
            return
        if i == len(rows) and len(legal) % 2 == 0 and (legal or not roles):
            found.append((cost, letters))
        if added < 2:
            for r in "ua":
                go(i, [*roles, r], cost + 3, letters + "I", added + 1)
        if i < len(rows):
            initial, must_go, cut = rows[i]
            go(i + 1, roles, cost + 4, letters + "D", 0)
            if not must_go:
                if initial in ("s", "u", "a") and not (initial == "s" and roles):
                    go(i + 1, [*roles, initial], cost + 3 * cut, letters + "K", 0)
                for r in "ua":
                    go(i + 1, [*roles, r], cost + 3 + 3 * cut, letters + "R", 0)

    go(0, [], 0, "", 0)
    return min(found)


def search(rows):
    out = []
    path = R.Survivors(lambda letters, times: out.append(letters * times))
    for r in rows:
        path.feed(*r)
    return path.close(), "".join(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", ""]), st.booleans(), st.booleans()), max_size=5))
def test_edits_are_the_cheapest_and_least(rows):
    assert search(rows) == cheapest(rows)


def test_little_is_held_however_long_a_conversation_is():
    rng, path, most = random.Random(5), R.Survivors(lambda letters, times: None), 0
    for _ in range(40_000):
        path.feed(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3)
        most = max(most, path.held())
    assert most < 200
    for feed in (("", False, False), ("u", True, False), ("a", False, True), ("s", False, False)):
        path = R.Survivors(lambda letters, times: None)
        for _ in range(5_000):
            path.feed(*feed)
        assert path.held() <= 12, feed


def test_references_are_counted():
    """Every node that a survivor reaches has as many references as children and survivors on it."""
    rng, path = random.Random(3), R.Survivors(lambda letters, times: None)
    for _ in range(2_000):
        path.feed(rng.choice(["u", "a", ""]), rng.random() < 0.3, rng.random() < 0.3)
        counted, seen = defaultdict(int), {}
        for leaf in {id(x): x for x in path.leaves if x is not None}.values():
            counted[id(leaf)] += sum(x is leaf for x in path.leaves)
            while leaf is not path.root and id(leaf) not in seen:
                seen[id(leaf)] = leaf
                counted[id(leaf.parent)] += 1
                leaf = leaf.parent
        assert all(n.refs == counted[k] for k, n in seen.items())


def repaired_brute(rows):
    """Digest of one conversation by the contract, all at once."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(R.WHITE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    marks = [(r[1][:1] if r[1][:1] in ("s", "u", "a") else "", k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds, strict=True)]
    cost, letters = cheapest(marks)
    out, n, state = [], 0, ""
    for letter in letters:
        to = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((to, ""))
        else:
            _, role, text = rows[n]
            n += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else to, text))
        state = out[-1][0][:1]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_repairs_equal_a_plain_version(spark, tables):
    rng = random.Random(11)
    texts = ["a.", "b", " ", "", " ", "c!\n\t", "long? " * 3000, None, "d.　"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 7]), rng.choice(["user", "assistant", "system", "tool", "", None, "uncle"]), rng.choice(texts)))
    found = R.digests(R.repair(tables(rows, SCHEMA + "").selectExpr("*", "'x' AS digest", "1 AS kind", "2 AS edits")))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    each = defaultdict(list)
    for conv, *rest in rows:
        each[conv].append(tuple(rest))
    assert set(got) == set(each)
    for conv, mine in each.items():
        assert got[conv] == repaired_brute(mine), conv


def test_repaired_rows_are_legal_and_keep_texts(spark, tables):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "s."), ("assistant", "x."), ("user", "q?"), ("user", "z"), ("assistant", "")])]
    out = [r.asDict() for r in R.repair(tables(rows, SCHEMA)).orderBy("position").collect()]
    assert "".join(r["role"][0] for r in out if r["role"]) in ("sua", "suaua", "ua", "uaua")
    assert [r["position"] for r in out] == list(range(len(out)))
    assert all(r["text"] is None for r in out if r["edit"] == "D")
    assert [r["fault"] for r in out if r["edit"] != "I"] == [None, None, None, "truncated", "blank"]


def test_one_conversation_of_many_rows(spark, tables):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k % 900}.") for k in range(3000)] + [(2, 0, "user", "a.")]
    found = {r["conv_id"]: r for r in R.digests(R.repair(tables(rows, SCHEMA))).collect()}
    assert found[1]["duplicate"] == 2100 and found[1]["cost"] == 2100 * 4 and found[1]["audit"] == "K" * 900 + "D" * 2100
    assert found[2]["audit"] == "D" or found[2]["audit"] == "KI"


def test_dropped_and_empty_conversations(spark, tables):
    given_, none = tables([(5, 0, "user", "a."), (None, None, None, None)], SCHEMA), tables([], SCHEMA)
    out = {r[0]: tuple(r)[1:] for r in R.with_all(given_, R.digests(R.repair(none))).collect()}
    assert out == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (5, None)}
    assert R.with_all(none, R.digests(R.repair(none))).count() == 0


def test_damage_follows_the_hash(spark, tables):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (None, 0, 1)]
    got = sorted(tuple(r) for r in Q.damage(tables(rows, SCHEMA)).fillna(-1, ["turn"]).collect())
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, -1 if t is None else t, "user" if code == 4 else role, "" if code == 1 else "One Two" if code == 2 else text)
        want += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    assert got == sorted(want)


# --- trie -----------------------------------------------------------------------------------

def nodes_brute(sequences):
    """Rows of the result from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += not kids[path]
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), kids[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def sequences_of(rows):
    each = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            each[c].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in each.items()}


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=["one batch", "small batches and blocks"])
def limits(request, monkeypatch):
    if request.param != "one batch":
        monkeypatch.setattr(P, "BATCH", 7)
        monkeypatch.setattr(P, "BLOCK", 4)
        monkeypatch.setattr(P, "_IDS", 3)


def test_nodes_equal_a_plain_version(spark, tables, limits):
    rng = random.Random(7)
    rows = []
    for c in [None, -7, *range(70)]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None, "é" * 5])))
    rows += [(900, k, "user", f"t{k % 3}") for k in range(60)] + [(901, k, "user", f"t{k % 3}") for k in range(57)]
    rows += [(c, k, "user", "same") for c in range(1000, 1030) for k in range(3)]
    df = tables(rows, SCHEMA).selectExpr("*", "1 AS depth", "'n' AS name", "2 AS key", "3 AS n")
    assert trie_rows(P.prefix_trie(P.turn_keys(df))) == nodes_brute(sequences_of(rows))


def test_conversations_without_turns_end_at_the_root(spark, tables):
    none, ids = tables([], SCHEMA), tables([(3,), (12,), (None,), (3,)], "conv_id long")
    assert trie_rows(P.prefix_trie(P.turn_keys(none), conversations=ids)) == nodes_brute({3: [], 12: []})
    assert trie_rows(P.prefix_trie(P.turn_keys(none))) == []


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    rows = [(4, k, "user", f"t{k % 5}") for k in range(5000)] + [(9, k, "user", f"t{k % 5}") for k in range(5000)] + [(2, 0, "user", "t0")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = P.prefix_trie(P.turn_keys(df))
    by_depth = {r["depth"]: r for r in found.collect()}
    assert len(by_depth) == 5001 and by_depth[1]["n_convs"] == 3 and by_depth[5000]["n_convs"] == 2
    assert by_depth[1]["conv_id"] == 2 and by_depth[2]["conv_id"] == 4 and by_depth[2]["parent_conv_id"] == 2
    assert by_depth[2]["saved_tokens"] == 4999 * 2 and by_depth[0]["n_leaves"] == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=20), min_size=1, max_size=12))
def test_handles_lead_to_every_node(paths):
    trie = P.ZFastTrie()
    runs = []
    for c, path in enumerate(paths):
        run = P._Run(c, 0, b"")
        for k in range(len(path)):
            run.names.append(bytes(path[:k + 1]))
            run.facts.append(1)
        runs.append(run)
        trie.insert(run)
    root, handles = trie.below[b""]
    nodes = list(trie.from_below())
    assert {id(n) for n in handles.values()} == {id(n) for n in nodes} and len(handles) == len(nodes)
    assert all(handles[n.name(P.fattest(n.top, n.depth))] is n and n.parent.depth == n.top for n in nodes)
    # A compacted node ends a path or branches.
    ends = {bytes(p) for p in paths}
    assert all(len(n.children) >= 2 or n.name(n.depth) in ends for n in nodes)
    expanded = {name: n for name, _, _, _, _, n in P._members(trie)}
    every = defaultdict(int)
    for p in paths:
        for k in range(len(p)):
            every[bytes(p[:k + 1])] += 1
    assert expanded == dict(every)


def test_few_probes_for_long_conversations():
    trie = P.ZFastTrie()
    for c in range(50):
        run = P._Run(c, 0, b"")
        for k in range(1000):
            run.names.append(hashlib.md5(f"{k}{c if k > 500 + c else ''}".encode()).digest())
            run.facts.append(0)
        trie.insert(run)
    assert trie.probes <= 50 * 11


def test_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert P.fattest(a, b) == max(range(a + 1, b + 1), key=lambda n: n & -n)


def test_rebuilt_conversations(spark, tables):
    rng = random.Random(2)
    rows = [(c, t, "user", f"{c} {t}") for c in [0, 3, 50, 99, 100, 101, 205, 1000, 1007, -3] for t in rng.sample(range(9), rng.randrange(1, 8))]
    own = sequences_of(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    turns, ids = Q.rebuilt(tables(rows, SCHEMA))
    assert trie_rows(P.prefix_trie(turns, "place", ids)) == nodes_brute(want)
