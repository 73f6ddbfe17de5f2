import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import ngram_join as N
from placeweave.llm import repeats as R
from placeweave.llm import vector_dedup as V
from placeweave.llm.common import LAST_ID, components
from placeweave.llm.shingles import WordHashes, shingle_sets, windows


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def union(self, x, y):
        a, b = self.find(x), self.find(y)
        self[max(a, b)] = min(a, b)


# Connected components

@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5000, x) for x in range(6000, 6300)] + [(7, 7)]
    rng.shuffle(edges)
    groups = Groups()
    for a, b in edges:
        groups.union(a, b)
    got = {r["v"]: r["m"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: groups.find(x) for x in list(groups) if groups.find(x) != x}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# N-gram sets

def gram_set(text, size=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ")
         .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def similar_brute(docs):
    sets = [gram_set(t) for _, t in docs]
    groups = Groups()
    for i, a in enumerate(sets):
        groups.find(i)
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.union(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        root = groups.find(i)
        least[root] = min(least.get(root, LAST_ID), LAST_ID if doc_id is None else doc_id)
    ids = [least[groups.find(i)] for i in range(len(docs))]
    return sorted(((d, len(s), None if c == LAST_ID else c) for (d, _), s, c in zip(docs, sets, ids)), key=repr)


def corpus(seed, n=120):
    """Copies, near copies, chains of near copies, shared passages and random texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.6:
            w = rng.choices(vocabulary, k=rng.randrange(30)) + passage + rng.choices(vocabulary, k=rng.randrange(30))
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 5, 6, 30, 200]))
        texts.append(" ".join(w))
    return texts


EDGE = [(None, "one two three"), (None, "one two three"), (901, "ONE two three"), (902, "One\ttwo\nthree"), (903, None), (904, ""), (905, " \n "),
        (906, "a b c d e f"), (906, "a different text of that id"), (907, "a b c d e f"), (907, "a b c d e f"), (908, "é É ß"), (909, "é É ß")]


@pytest.mark.parametrize("seed", range(2))
def test_similar_documents_equal_brute_force(tables, seed):
    docs = [(i * 7 % 1000, t) for i, t in enumerate(corpus(seed))] + EDGE
    df = tables(docs, "doc_id long, text string").withColumns({"tie": F.lit("clash"), "node": F.lit(1)})
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.similar_documents(df).collect()]
    assert sorted(got, key=repr) == similar_brute(docs)


def test_blocks_give_the_same_groups(tables, monkeypatch):
    docs = [(i, t) for i, t in enumerate(corpus(5, 80))]
    monkeypatch.setattr(N, "TASK_GRAMS", 300)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.similar_documents(tables(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == similar_brute(docs)


def test_common_passages_do_not_chain_documents(tables, monkeypatch):
    rng = random.Random(8)
    passages = [rng.choices([f"p{i}" for i in range(90)], k=9) for _ in range(12)]
    docs = []
    for i in range(60):
        own = [f"d{i}w{j}" for j in range(60)]
        words = own + rng.choice(passages) + rng.choice(passages) + own[:3] + rng.choice(passages)
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["end"]))]
    sizes, links = [], N.links_in_parts

    def seen(sets, parts):
        sizes.extend(r["count"] for r in parts.groupBy("part").count().collect())
        return links(sets, parts)

    monkeypatch.setattr(N, "links_in_parts", seen)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.similar_documents(tables(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == similar_brute(docs)
    assert sum(sizes) == 120 and max(sizes) <= 6


def test_each_two_blocks_meet_in_one_round(spark):
    blocks = {3: 4, 4: 1, 5: 7, 7: 2}
    rows = [(level, b, n, blocks.get(level - 1, 0), blocks.get(level + 1, 0)) for level, n in blocks.items() for b in range(n)]
    dealt = spark.createDataFrame(rows, "level int, block int, blocks int, below int, above int")
    met = []
    for at in range(7):
        found = {}
        for r in dealt.select("level", "block", N._meeting(at).alias("meets")).collect():
            assert len(r["meets"]) <= 3
            for m in r["meets"]:
                found.setdefault(tuple(m), set()).add((r["level"], r["block"]))
        assert all(1 <= len(who) <= 2 for who in found.values())
        met += [tuple(sorted(who)) for who in found.values()]
    own = [(level, b) for level, n in blocks.items() for b in range(n)]
    assert sorted(met, key=repr) == sorted([(x,) for x in own] + [(x, y) for x in own for y in own if x < y and y[0] - x[0] <= 1], key=repr)


def test_one_of_each_group_is_first(tables):
    docs = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (4, None), (5, "x"), (None, "a b c d e f")]
    rows = N.similar_documents(tables(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["first"]) == [(1, 1), (4, 4), (5, 5)]


def test_similar_documents_empty(tables):
    assert N.similar_documents(tables([(1, "a")], "doc_id long, text string").limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_prefix_tree_finds_all_groups(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(4)]
    sets = []
    for _ in range(40):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s ^= {rng.randrange(60)}
        if s:
            sets.append(np.array(sorted(s), np.uint64))
    groups, found = Groups(), Groups()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                groups.union(i, j)
    for a, b in N.spanning_links(np.arange(len(sets)), sets):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
        found.union(a, b)
    assert [groups.find(i) for i in range(len(sets))] == [found.find(i) for i in range(len(sets))]


def test_shingles_and_windows():
    seen = WordHashes()
    a, b, c = shingle_sets(["a b c d e f", "x A b c d e f", None], 5, seen)
    assert len(a) == 2 and len(b) == 3 and len(c) == 0 and set(a) < set(b)
    hashes = seen.of([b"a", b"b", b"a", b"b", b"a"])
    for size in (1, 2, 3, 4):
        got = windows(hashes, size)
        assert [got[i] == got[0] for i in range(len(got))] == [i % 2 == 0 for i in range(5 - size + 1)]


# Repeats

def removed_brute(docs, ties, size):
    """docs: (id, text); ties: hash of each text. Kept words by (order id, text)."""
    key = {(d, t): (LAST_ID if d is None else d, ties[t]) for d, t in docs}
    split = {(d, t): [w for w in (t or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w] for d, t in docs}
    first = {}
    for doc in sorted(set(docs), key=lambda x: key[x]):
        w = split[doc]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (doc, i))
    out = []
    for doc in docs:
        w, gone = split[doc], set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (doc, i):
                gone.update(range(i, i + size))
        out.append((doc[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,size", [(0, 20), (1, 20), (2, 8), (3, 20)])
def test_repeats_equal_brute_force(spark, tables, monkeypatch, seed, size):
    monkeypatch.setattr(R, "CHUNK", 500)
    monkeypatch.setattr(R, "NAMED_CHUNK", 700)
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    texts = corpus(seed, 60) + ["run " * 70, "run " * 25 + "end", "start " + "run " * 40, "a b " * 40, "x a b " * 30, "b a " * 21]
    texts += [" ".join(rng.choices(vocabulary[:3], k=90)) for _ in range(5)]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + EDGE
    docs += [(950, texts[-1]), (950, texts[-1]), (None, texts[-2]), (950, texts[-2]), (951, "\x1c".join(texts[-1].split())), (952, texts[-1].replace(" ", " \n"))]
    df = tables(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "n_words": F.lit("clash"), "spans": F.lit(2)})
    ties = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    done = R.remove_repeats(df, size, out=("kept", "words", "gone"))
    assert done.columns == [*df.columns, "kept", "words", "gone"]
    rows = done.collect()
    assert sorted(((r["doc_id"], r["words"], r["gone"], r["kept"]) for r in rows), key=repr) == removed_brute(docs, ties, size)
    assert {r["key"] for r in rows} == {"clash"} and sorted((r["text"] for r in rows), key=repr) == sorted((t for _, t in docs), key=repr)


def test_repeats_empty(tables):
    assert R.remove_repeats(tables([(1, "a")], "doc_id long, text string").limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_equal_windows_have_equal_anchors(seed):
    """What a window's anchor is, and where in it, depends on its words alone."""
    rng = np.random.default_rng(seed)
    few = rng.integers(1, 2 ** 63, 3 if seed % 2 else 50).astype(np.uint64)
    docs = [rng.choice(few, rng.integers(1, 120)) for _ in range(30)]
    for _ in range(30):
        source = docs[rng.integers(len(docs))]
        docs.append(np.concatenate([rng.choice(few, rng.integers(0, 9)), source[rng.integers(len(source)):], rng.choice(few, rng.integers(0, 9))]))
    docs.append(np.repeat(few[:1], 90))
    begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    words = np.concatenate(docs)
    seen = {}
    start, position, name = R.anchors(words, begins, 20)
    assert len(start) == sum(max(0, len(d) - 19) for d in docs)
    for s, p, n in zip(start.tolist(), position.tolist(), name.tolist()):
        assert seen.setdefault(tuple(words[s:s + 20].tolist()), (p - s, n)) == (p - s, n)


# Vectors

def vectors_brute(rows, threshold=0.98):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    groups, links = Groups(), [0] * len(rows)
    for i, (_, v, a) in enumerate(rows):
        groups.find(i)
        for j in range(i):
            w, b = rows[j][1], rows[j][2]
            if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    groups.union(i, j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        root = groups.find(i)
        least[root] = min(least.get(root, LAST_ID), LAST_ID if vec_id is None else vec_id)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        c = least[groups.find(i)]
        out.append((vec_id, links[i], None if c == LAST_ID else c, (LAST_ID if vec_id is None else vec_id) == c))
    return sorted(out, key=repr)


def cloud(seed, n, length=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            v = np.array(out[rng.integers(len(out))]) + rng.normal(0, rng.choice([0, 0.03, 0.06]), length)
        else:
            v = rng.normal(0, 1, length)
        out.append(v.astype(np.float32).tolist())
    return out


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0] * 16, None),
       (906, [1.0] * 16, 1), (906, [1.0] * 16, 1), (906, [-1.0] * 16, 1), (None, [1.0] * 16, 1), (907, [1e38] * 16, 1), (908, [1e-38] * 16, 1), (909, [1.0] * 3, 1),
       (910, [1.0, 1.0, 1.01], 1), (911, [], 1), (912, [-0.0] + [1.0] * 15, 2), (913, [0.0] + [1.0] * 15, 2)]


@pytest.mark.parametrize("leaf,rules", [(1024, 20_000), (16, 20_000), (16, 1)])
def test_vectors_equal_brute_force(tables, monkeypatch, leaf, rules):
    monkeypatch.setattr(V, "LEAF", leaf)
    monkeypatch.setattr(V, "RULES", rules)
    monkeypatch.setattr(V, "SAMPLE", 64)
    rows = [(i * 3 % 700, v, i % 3 and 1) for i, v in enumerate(cloud(1, 250))] + ODD
    df = tables(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = sorted((tuple(r) for r in V.similar_vectors(df).collect()), key=repr)
    want = vectors_brute(rows)
    if leaf == 1024:
        assert got == want
    else:  # trees may tear a pair apart: nothing is added, and nearly all is found
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.97 * there <= found <= there


def test_dense_group_is_cut_into_blocks(tables, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 8)
    monkeypatch.setattr(V, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, 16)
    rows = [(i, (centre + rng.normal(0, 0.01, 16)).tolist(), 1) for i in range(60)] + [(100 + i, centre.tolist(), 1) for i in range(40)]
    got = V.similar_vectors(tables(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["n_links"] for r in got} == {99} and {r["component_id"] for r in got} == {0} and [r["vec_id"] for r in got if r["kept"]] == [0]


def dense(seed, n, cosine, length=64):
    """Vectors of which any two have about this cosine."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 1, length) / np.sqrt(length) + rng.normal(0, np.sqrt((1 / cosine - 1) / length), (n, length))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@pytest.mark.parametrize("cosine", [0.999, 0.98])
def test_dense_cells_are_not_multiplied(spark, monkeypatch, cosine):
    monkeypatch.setattr(V, "LEAF", 128)
    nodes = [(1, i, 1, v.tolist()) for i, v in enumerate(dense(3, 600, cosine))]
    # A root that is spread out, with a dense group inside it.
    wide = np.random.default_rng(4).normal(0, 1, (600, 64))
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    nodes += [(2, 1000 + i, 1, v.tolist()) for i, v in enumerate([*wide, *dense(5, 300, cosine)])]
    found = V.leaves(spark.createDataFrame(nodes, "root long, node long, weight long, vector array<double>")).cache()
    # The dense root is one cell of one tree, and every node is in a cell of each tree of the other.
    first = found.filter("node < 1000")
    assert first.count() == 600 and first.select("cell").distinct().count() == 1
    assert found.filter("node >= 1000").groupBy("node").count().filter(f"count < {V.TREES}").count() == 0
    assert found.filter("node >= 1600").count() <= 3 * V.TREES * 300


def test_planted_pairs_in_a_large_label(spark):
    """20,000 vectors of one label with 1,500 pairs just above the threshold, against all pairs: at
    least 0.99 of the links, nothing else, and few copies of rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (18_500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(0, 1, (1_500, 64))
    off -= (off * x[:1_500]).sum(1, keepdims=True) * x[:1_500]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = 0.981
    x = np.concatenate([x, cosine * x[:1_500] + np.sqrt(1 - cosine**2) * off])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    links = {r["vec_id"]: r["n_links"] for r in V.similar_vectors(df).collect()}
    there = sum(int((x[a:a + 1000] @ x.T >= 0.98).sum()) - len(x[a:a + 1000]) for a in range(0, len(x), 1000))
    assert there >= 3_000 and 0.99 * there <= sum(links.values()) <= there


@pytest.mark.parametrize("cosine", [0.0, 0.9])
def test_trees_copy_few_rows(spark, cosine):
    """Splits that would copy many nodes to both sides are not made."""
    x = dense(6, 12_000, cosine) if cosine else np.random.default_rng(5).normal(0, 1, (12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(1, i, 1, v.tolist()) for i, v in enumerate(x)], "root long, node long, weight long, vector array<double>")
    assert V.leaves(nodes).count() <= 8 * len(x)


def test_vectors_empty(tables):
    assert V.similar_vectors(tables([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").limit(0)).count() == 0
