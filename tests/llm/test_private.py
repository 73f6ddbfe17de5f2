"""Personal data: the rules against plain regular expressions, the judge on held-out documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.llm import boosting as B
from placeweave.llm import private_data as P
from placeweave.llm import q_private as Q

SF = "/root/testdata/sf0.01"

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """Base spans as the contract states them."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                  kind == 2 and 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0,
                  8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@-+ (0123456789)%é\n", max_size=60))
def test_rules_equal_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_rules_equal_plain_patterns_on_documents(spark):
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert P.base_spans(row["text"] or "") == plain(row["text"] or "")


@pytest.mark.parametrize("text", ["1" * 200_000, "a." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "+1" + " " * 100_000, "1.1." * 50_000,
                                  "12 34 " * 30_000, "a@" * 100_000, "1-" * 100_000, "f:" * 100_000])
def test_long_texts_take_linear_time(text):
    P.base_spans(text)
    P.candidates(text)


def card(rng):
    digits = [rng.randrange(1, 10) for _ in range(15)]
    for last in range(10):
        if P.luhn("".join(map(str, [*digits, last]))):
            return "".join(map(str, [*digits, last]))


@pytest.fixture(scope="module")
def judge(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        words = [rng.choice("the of and letter pay for it then".split()) for _ in range(30)]
        words[5] = card(rng)
        words[9] = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        words[14] = str(rng.randrange(10**15, 10**16))
        words[20] = str(rng.randrange(10**7, 10**9))
        rows.append((i, " ".join(words)))
    return P.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_joined_numbers_are_told_apart(judge):
    """Two cards in a row, and a telephone before an address, are too long for the rules."""
    rng = random.Random(9)
    a, b = card(rng), card(rng)
    text = f"pay {a} {b} or +1 (826) 555-4081 190.137.223.204 then"
    assert [s for s in P.base_spans(text) if s[0] in (2, 3)] == []
    found = {text[s["start"]:s["end"]]: s for s in P.spans_of(text, judge)}
    assert {a, b, "+1 (826) 555-4081", "190.137.223.204"} <= set(found)
    assert found["190.137.223.204"]["base"] and not found[a]["base"] and 0 < found[a]["score"] <= 1


def test_other_numbers_are_left_alone(judge):
    rng = random.Random(10)
    for _ in range(200):
        n = str(rng.randrange(10**15, 10**16))
        if not P.luhn(n):
            assert P.spans_of(f"the order {n} of 2024-05-06 12:30:45 and 1234567 for it", judge) == []


def test_added_spans_overlap_nothing(judge):
    rng = random.Random(12)
    for _ in range(60):
        text = " ".join(rng.choice([card(rng), "+1 (826) 555-4081", "10.0.0.1", "a@b.cd", "12", "7777"]) for _ in range(12))
        spans = P.spans_of(text, judge)
        base = [(P.KINDS.index(s["kind"]), s["start"], s["end"]) for s in spans if s["base"]]
        assert base == P.base_spans(text)
        for s in spans:
            if not s["base"]:
                assert all(s is o or o["end"] <= s["start"] or s["end"] <= o["start"] for o in spans)


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (4000, 5)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 3] < 4)).astype(np.int64)
    model = B.fit(x[:2000], y[:2000])
    B.calibrate(model, x[2000:3000], y[2000:3000])
    p = model.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.99
    assert abs(p.mean() - y[3000:].mean()) < 0.02
    assert (p[y[3000:] == 1] >= B.threshold(p, y[3000:], 0.99)).mean() > 0.95
    assert B.threshold(p, np.zeros(len(p), np.int64), 0.9) > 1


def test_cases(spark, tables, judge):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "x " * 50_000 + "a@b.cd"), (3, "x " * 50_000 + "a@b.cd"), (4, "É a@b.cd")]
    docs = tables(rows, "doc_id long, text string").selectExpr("*", "'k' AS spans", "1 AS kind", "2 AS score")
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in P.find_spans(docs, judge).collect()), key=repr)
    late = [("email", 100_000, 100_006)]
    assert got == sorted([(1, []), (2, []), (None, [("email", 0, 6)]), (3, late), (3, late), (4, [("email", 2, 8)])], key=repr)
    cut = {r["doc_id"]: r for r in P.redact(docs, judge).filter("doc_id <> 3").collect()}
    assert cut[4]["text"] == "É [email]" and cut[1]["text"] is None and cut[4]["spans"] == "k"
    none = tables([], "doc_id long, text string")
    empty = P.fit(none)
    assert empty.models == {} and P.find_spans(none, empty).count() == 0


def test_held_out_examples(spark):
    """On documents that the trees have not seen, what they choose is what the rules choose."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    judge = P.fit(docs)
    assert P.KINDS.index("card") in judge.models
    hits = misses = wrong = 0
    for row in docs.filter(P.held_out("doc_id")).collect():
        for kind, label, start, values in P.examples(row["text"] or ""):
            if kind in judge.models:
                chosen = judge.models[kind].probability(np.array([values], float))[0] >= judge.thresholds[kind]
                hits += label and chosen
                misses += label and not chosen
                wrong += chosen and not label
    assert hits > 20 and misses <= 0.05 * (hits + misses) and wrong <= 0.03 * (hits + wrong)


def test_query_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in Q.op13_private(spark, SF).collect():
        base = plain(texts[row["doc_id"]])
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == n for s in base) for n in range(4)]
        named = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(row["spans"].split(","))


def test_all_documents_are_learnt_from(spark):
    """Cards in 40 of 80,000 documents: a sample would hold too few."""
    rng, ids = random.Random(3), {True: [], False: []}
    for i in range(1000):
        ids[zlib.crc32(str(i).encode()) % 5 == 0].append(i)
    rows = [(i, f"pay {card(rng)} for {rng.randrange(10**13, 10**14)} and {rng.randrange(10**13, 10**14)}") for late in (True, False) for i in ids[late][:20]]
    plain = spark.range(1000, 81_000).selectExpr("id AS doc_id", "'of the' AS text")
    judge = P.fit(spark.createDataFrame(rows, "doc_id long, text string").unionByName(plain))
    assert P.KINDS.index("card") in judge.models


def test_trees_from_rows_in_spark_equal_those_in_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(9000, 4)), 2)
    y = (x[:, 0] + x[:, 2] ** 2 + rng.normal(0, 0.3, 9000) > 0.7).astype(int)
    data = [(k % 2, int(y[k]), x[k].tobytes()) for k in range(9000)]
    rows = spark.createDataFrame(data, "kind int, label int, features binary").repartition(5).groupBy("kind", "label", "features").agg(F.count("*").alias("n"))
    cuts = B.quantiles(rows, 4)
    shares = {k: y[k::2].mean() for k in (0, 1)}
    models = B.fit_rows(B.coded(rows, cuts, 4).cache(), cuts, shares, rounds=3)
    counts = B.margin_counts(rows, models, 4)
    for k in (0, 1):
        here, there = B.fit(x[k::2], y[k::2], rounds=3), models[k]
        assert np.array_equal(here.features, there.features) and np.array_equal(here.limits, there.limits) and np.allclose(here.values, there.values)
        B.calibrate(here, x[k::2], y[k::2])
        B.calibrate_counts(there, *counts[k])
        p = here.probability(x[k::2])
        assert np.allclose(p, there.probability(x[k::2]))
        assert np.isclose(B.threshold(p, y[k::2], 0.9), B.threshold(there.scaled(counts[k][0]), counts[k][1], 0.9, counts[k][2]))
