import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import license_scan as L
from placeweave.llm import packing as P
from placeweave.llm import quality as Q
from placeweave.llm import token_counts as T
from placeweave.llm.license_texts import MORE, TEMPLATES
from placeweave.llm.tokens import Encoder, vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "a \n b", "  x", "x \x1c y", "a b ", "\n\n c  ", "it's  's don't", " 　", "  a", "é è  \t x 12 3 4",
       "a" * 3000 + " " + "b" * 300, "<|endoftext|> <|endoftext|>", "日本語 テキスト", "👍🏽 ok", "\x00 \x7f"]
EDGE = [(901, None), (902, ""), (None, "one two"), (903, "one two"), (903, "one two"), (903, "three"), (904, "word " * 30_000)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer(texts):
    encode = Encoder(vocabulary_path())
    for text, ids in zip(texts + ODD, reference_ids(texts + ODD), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids
        assert np.frombuffer(encode(text), "<u4").tolist() == ids  # and again from memory


def test_added_tokens_are_those_of_the_library_by_default(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    from placeweave.llm.tokens import encoder

    end = "<|endoftext|>"
    some = [*ODD, f"a {end} b", end, f"{end}{end}", f"x{end}", f" {end}  y", f"a\n{end}\n\n b ", f"<|endof{end}text|>", "<|endoftext|"]
    path = vocabulary_path()
    reference = Tokenizer.from_file(path)
    ids = [x.ids for x in reference.encode_batch(some, add_special_tokens=False)]
    assert ids[len(ODD)] == [64, 220, 50256, 275]
    encode = encoder(path)
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in some] == ids
    rows = P.pack(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows if r["piece"] == 0 and r["doc_id"] >= len(ODD)} == {
        i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(ids) if i >= len(ODD)}
    # Tokens with flags, and one that begins another.
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    model["added_tokens"].append(model["added_tokens"][0] | {"id": 50257, "content": "<|end", "lstrip": True})
    other = tmp_path / "added.json"
    other.write_text(json.dumps(model))
    some += ["a  <|end b", f"a  {end} <|end"]
    ids = [x.ids for x in Tokenizer.from_file(str(other)).encode_batch(some, add_special_tokens=False)]
    encode = encoder(str(other))
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in some] == ids


# Packing

def test_pieces_of_a_document():
    assert P.cuts(1, 10) == [(0, 1)] and P.cuts(10, 10) == [(0, 10)] and P.cuts(11, 10) == [(0, 1), (1, 10)] and P.cuts(20, 10) == [(0, 10), (10, 10)]


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_is_whole_and_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.randrange(300))]
    bins = P.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 6 / 9 + sum(s > 50 for s in sizes)


@pytest.mark.parametrize("parts,carry", [(1, 4096), (20, 4096), (20, 3)])
def test_packing_is_an_exact_cover(spark, texts, monkeypatch, parts, carry):
    monkeypatch.setattr(P, "CARRY", carry)
    docs = [(i, t) for i, t in enumerate(texts)] + EDGE
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bin", F.lit("x")).repartition(parts)
    rows = P.pack(df).collect()
    expected, total = [], 0
    for (doc_id, _), ids in zip(docs, reference_ids([t or "" for _, t in docs]), strict=True):
        ids = [*ids, 2]
        total += len(ids)
        for k, (start, n) in enumerate(P.cuts(len(ids), 1024)):
            expected.append((doc_id, k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
    least = -(-total // 1024)
    assert len(places) <= (least + 2 if carry > 3 else least + 20)


@pytest.mark.parametrize("seed", range(50))
def test_best_fit_of_counts_is_that_of_the_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    low, high = sorted(rng.randint(1, capacity) for _ in range(2))
    sizes = sorted((rng.randint(low, high) for _ in range(rng.randrange(400))), reverse=True)
    n, placed = P.best_fit_counts({s: sizes.count(s) for s in sizes}, capacity)
    assert n == len(P.best_fit(sizes, capacity))
    bins = {}
    for at, size in enumerate(sizes):
        rank = at - sizes.index(size)
        _, first, bin_, each, offset = max(p for p in placed if p[0] == size and p[1] <= rank)
        into, nth = divmod(rank - first, each)
        bins.setdefault(bin_ + into, []).append((offset + nth * size, size))
    assert sorted(bins) == list(range(n))
    for members in bins.values():
        members.sort()
        assert [o for o, _ in members] == [sum(s for _, s in members[:i]) for i in range(len(members))]
        assert sum(s for _, s in members) <= capacity


def test_lengths_that_differ_between_tasks_share_sequences(spark):
    # 9,000 documents of 600 ids in one task and 9,000 of 420 in the other: one of each fits.
    texts = spark.range(18_000, numPartitions=2).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit(" a"), F.when(F.col("id") < 9_000, 599).otherwise(419)).alias("text"))
    rows = P.pack(texts)
    assert rows.select("doc_id").distinct().count() == rows.count() == 18_000
    assert rows.select("sequence_id").distinct().count() == 9_000
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("o")).filter("n <> 1020 OR o <> 600").count() == 0


def without_rounds(tasks):
    """Sequences if the open bins of all tasks are packed once, together, by counts."""
    final, open_, pieces = 0, Counter(), Counter()
    for sizes in tasks:
        for members in P.best_fit(sizes, 1024):
            used = sum(sizes[i] for i in members)
            if 1024 - used <= P.NEARLY_FULL:
                final += 1
            else:
                open_[used] += 1
                pieces.update(sizes[i] for i in members)
    return final + min(P.best_fit_counts(c, 1024)[0] for c in (open_, pieces))


@pytest.mark.parametrize("case", ["sizes by task", "two sizes", "small ones", "many tasks"])
def test_rounds_take_no_more_sequences(spark, monkeypatch, case):
    rng = random.Random(3)
    tasks = {
        "sizes by task": [[rng.randint(560, 700) for _ in range(3000)] for _ in range(3)] + [[rng.randint(300, 440) for _ in range(3000)] for _ in range(5)],
        "two sizes": [[600] * 3000, [420] * 3000],
        "small ones": [[rng.randint(1, 90) for _ in range(40)] for _ in range(30)],
        "many tasks": [[min(1024, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(60)] for _ in range(40)],
    }[case]
    monkeypatch.setattr(P, "ITEMS", 3000)
    seen = []
    merge = P.merge_round
    monkeypatch.setattr(P, "merge_round", lambda bins, groups, *a: seen.append(groups) or merge(bins, groups, *a))
    rows = []
    for t, sizes in enumerate(tasks):
        for b, members in enumerate(P.best_fit(sizes, 1024)):
            used, offset = sum(sizes[i] for i in members), 0
            for i in members:
                rows.append((t * 10**6 + i, 0, 0, sizes[i], 0, (t << P._TASK) + b, offset, 1024 - used <= P.NEARLY_FULL, used))
                offset += sizes[i]
    docs = spark.createDataFrame([(0, "")] * len(tasks), "doc_id long, text string").repartition(len(tasks))
    table = spark.createDataFrame(rows, P._SCHEMA)
    monkeypatch.setattr(P, "encode_and_pack", lambda *a: table)
    placed = P.pack(docs, vocabulary="none")
    assert placed.select("doc_id").distinct().count() == placed.count() == len(rows)
    found = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("o"), F.count("*").alias("c"))
    assert found.filter("n > 1024 OR end <> n OR o <> c").count() == 0
    assert found.count() <= without_rounds(tasks)
    assert len(seen) >= 2 if len(tasks) > 4 and case != "sizes by task" else seen


def test_packing_of_nothing(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Token counts

def greedy(word, first, rest):
    at = n = 0
    while at < len(word):
        pieces = first if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(300))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)

    def some(k):
        return {bytes(rng.choices(b"abc"[: rng.choice([1, 2, 3])], k=rng.randint(1, 5))) for _ in range(k)}
    first, rest = some(rng.randint(1, 8)), some(rng.randint(0, 8)) if seed % 2 else set()
    match = T.LongestMatch(first, rest)
    for _ in range(20):
        word = bytes(rng.choices(b"abc", k=rng.randrange(10)))
        assert match.count(word) == greedy(word, first, rest or first)


def test_token_counts_equal_brute_force(tables, texts):
    import json

    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    to_byte = T.byte_of_character()
    pieces = {bytes(to_byte[c] for c in v.removesuffix("</w>")) + (T.END if v.endswith("</w>") and v != "</w>" else b"")
              for v in vocabulary if all(c in to_byte for c in v.removesuffix("</w>"))}
    docs = [(i, t) for i, t in enumerate(texts[:40] + ODD)] + EDGE[:-1]

    def count(text):
        return sum(greedy(part.encode() + T.END, pieces, pieces) for w in (text or "").split() for part in T._PARTS.findall(w.lower()))
    got = T.count_tokens(tables(docs, "doc_id long, text string").withColumn("n_words", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, len((t or "").split()), count(t)) for d, t in docs), key=repr)


def test_word_pieces_with_a_prefix(tmp_path, spark):
    path = tmp_path / "pieces.json"
    path.write_text('{"model": {"type": "WordPiece", "vocab": {"un": 0, "##aff": 1, "##able": 2, "##a": 3, "able": 4}}}')
    docs = spark.createDataFrame([(1, "unaffable able affable una")], "doc_id long, text string")
    # un ##aff ##able; able; unknown; un ##a
    assert T.count_tokens(docs, str(path), end="").first()["n_tokens"] == 3 + 1 + 1 + 2


def test_token_counts_of_nothing(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Licences

def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(50))
def test_alignment_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    template = [rng.randrange(40) for _ in range(20)]
    text = [rng.randrange(40) for _ in range(rng.randrange(10))] + [t for t in template if rng.random() < 0.9] + [rng.randrange(40) for _ in range(5)]
    pairs = L.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(text, template)
    assert L.align(template, template) == [(i, i) for i in range(20)]


def test_rising_is_longest():
    rng = random.Random(1)
    for _ in range(100):
        values = rng.sample(range(30), rng.randrange(20))
        found = [values[i] for i in L.rising(values)]
        assert found == sorted(found) and len(found) == longest_common(values, sorted(values))


def test_notices_are_found(tables):
    rng = random.Random(2)
    noise = [" ".join(rng.choices(["the", "of", "license", "under", "work", "x1", "x2", "x3"], k=200)) for _ in range(8)]
    docs, want = [], []
    for i, (name, text) in enumerate(TEMPLATES):
        docs.append((i, f"{noise[i]}\n{text.upper()}\n{noise[-1 - i]}"))
        want.append((i, name))
        words = L.words_of(text)
        edited = [w for k, w in enumerate(words) if len(words) < 10 or k % 9]
        docs.append((100 + i, "lorem ipsum " * 2000 + " ".join(edited)))
        want.append((100 + i, name))
    docs += [(200, None), (200, ""), (None, noise[0]), (201, "MIT"), (202, "the license of the work " * 300)]
    got = L.scan(tables(docs, "doc_id long, text string").withColumn("license", F.lit(0))).collect()
    found = {r["doc_id"]: r for r in got if r["license"]}
    assert sorted(found) == sorted(i for i, _ in want) and len(got) == len(docs)
    for doc_id, name in want:
        assert name in found[doc_id]["licenses"] and found[doc_id]["coverage"] >= L.COVERAGE
        assert found[doc_id]["first_word"] <= found[doc_id]["last_word"] < found[doc_id]["n_words"]
    assert L.scan(tables(docs, "doc_id long, text string").limit(0)).count() == 0
    assert all(r["license"] is None for r in L.scan(tables(docs, "doc_id long, text string"), templates=(("none", "..."),)).collect())


LISTED = L.listed_templates(TEMPLATES + MORE, L.COVERAGE)


def scan_brute(text):
    """(name, aligned, first, last) of every template, from every stretch."""
    words, out = L.words_of(text), []
    for t in LISTED:
        best = (0, 0, 0)
        for first in range(0, max(len(words), 1), t.step):
            pairs = t.at(words, first)
            if len(pairs) > best[0]:
                best = len(pairs), first + pairs[0][0], first + pairs[-1][0]
        if best[0]:
            out.append((t.name, *best))
    return out


def test_scan_equals_brute_force(spark):
    """All stretches of texts with whole, cut, edited, mixed and repeated notices, with the same aligner."""
    rng = random.Random(5)
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(LISTED).words
            cut = words[rng.randrange(3):len(words) - rng.randrange(3)]
            parts += [w if rng.random() > 0.08 else rng.choice(["", "x", "the", "license"]) for w in cut]
            parts += rng.choices(["the", "software", "license", "of", "x", "3", "general"], k=rng.randrange(40))
        docs.append((k, " ".join(parts)))
    for row in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        want = scan_brute(docs[row["doc_id"]][1])
        assert row["licenses"] == sorted({w[0] for w in want})
        if want:
            sizes = {(t.name, t.size) for t in LISTED}
            covered = [(n, a / s, f, e) for n, a, f, e in want for m, s in sizes if m == n]
            assert (row["license"], row["coverage"], row["first_word"], row["last_word"]) in [(n, c, f, e) for n, c, f, e in covered]


def test_kin_are_told_apart(spark):
    """A wording is found as itself and as no other licence; one-liners may stand in longer ones."""
    one_liners = {t.name for t in LISTED if t.short}
    longer = [t for t in LISTED if not t.short]
    docs = [(i, "x y z " + " ".join(t.words) + " and more of it") for i, t in enumerate(longer)]
    for row in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        t = longer[row["doc_id"]]
        assert t.name in row["licenses"]
        assert {L.family(n) for n in row["licenses"] if n not in one_liners} <= {L.family(t.name)}, (t.name, row["licenses"])


def test_a_long_text_that_repeats_a_word(spark):
    """As many alignments as there are stretches, at most."""
    word = "software copyright notice license the of "
    template = max(LISTED, key=lambda t: t.size)
    words = (word * 20_000).split()
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    assert len(template.starts(len(words), places)) <= len(words) // template.step + 1


@pytest.mark.parametrize("text,want", [
    ("Released under the BSD License.", ["BSD"]), ("Released under the Apache License.", ["Apache"]), ("Released under the XYZ License.", []),
    ("Released under the MIT License.", ["MIT"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY-NC 3.0.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("(C) X. All rights reserved. Released under the MIT License.", ["MIT", "all-rights-reserved"]), ("All rights reserved.", ["all-rights-reserved"])])
def test_the_word_that_names_a_licence_counts(text, want, spark):
    docs = spark.createDataFrame([(1, f"some words before. {text} And some words after")], "doc_id long, text string")
    row = L.scan(docs).first()
    assert row["licenses"] == want and row["license"] == (want[0] if want else None)


# Quality

def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = spark.range(200).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (300, Q.TERMS)).astype(np.float32)
    labels = (counts[:, :20].sum(1) > 20).astype(np.int64)
    model = Q.fit_counts(counts[:200], labels[:200])
    asked = np.concatenate([counts[200:], np.zeros((1, Q.TERMS), np.float32)])
    got = model.score(asked)
    for row, value in zip(model.embed(asked)[:-1], got, strict=False):
        cosine = model.vectors @ row
        near = np.argsort(-cosine)[: Q.NEIGHBOURS]
        votes = np.clip(cosine[near], 1e-6, None).astype(float) ** Q.SHARPNESS
        assert abs((votes * model.labels[near]).sum() / votes.sum() - value) < 1e-4
    assert got[-1] == labels[:200].mean() and ((0 <= got) & (got <= 1)).all()


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id").filter("doc_id < 2500").select("doc_id", "text").withColumn("label", F.lit("clash"))
    model = Q.fit(some, labels)
    rows = Q.score(some, model).join(labels, "doc_id").filter(Q.held_out("doc_id")).select("quality", "quality_score").collect()
    right = {q: [(r["quality_score"] >= Q.THRESHOLD) == bool(q) for r in rows if r["quality"] == q] for q in (0, 1)}
    assert np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.85


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (4, None), (903, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "A plain text."), (2, "JUNK!! JUNK!!"), *EDGE], "doc_id long, text string").withColumns(
        {"quality_score": F.lit("old"), "counts": F.lit(1)})
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(EDGE) + 2 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert {r["quality_score"] for r in rows if not r["text"]} == {model.prior}
    nothing = Q.fit(docs, labels.limit(0))
    assert {r["quality_score"] for r in Q.score(docs, nothing).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0 and Q.fit(docs.limit(0), labels).prior == 0.5
