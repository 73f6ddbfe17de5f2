import hashlib
import re

import pytest
from pyspark.sql import functions as F

from placeweave.llm import decontaminate as D
from placeweave.llm import url_filter as U

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13, share=20):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(size, len(b))
            if item is None or not n:
                continue
            for s in range(len(b) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"w{i}" for i in range(20))
DOCS = [
    (1, f"before it {PASSAGE.upper()}! after"), (2, " ".join(f"w{i}" for i in range(12))), (3, None), (4, ""), (5, "short Item"),
    (6, "x " * 3000 + PASSAGE), (6, "the other text of the id short item"), (None, PASSAGE), (None, "nothing"), (7, "the " * 50),
    (8, PASSAGE + " " + PASSAGE), (8, PASSAGE + " " + PASSAGE), (9, "é\x00short,item\u3000x"), (10, "short item short item"),
]
ITEMS = [(1, PASSAGE), (2, "Short item"), (2, "w3 w4 w5"), (None, "the the"), (3, None), (4, "..."), (5, "the the the"), (1, PASSAGE)]


def test_items_without_an_id_are_hit_and_not_listed(spark):
    docs = spark.createDataFrame([(1, "aa secret passage here"), (2, "other words"), (3, "a listed passage")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "secret passage"), (7, "listed passage")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in D.decontaminate(docs, items).collect()}
    assert got == {1: (2, [], True), 2: (0, [], False), 3: (2, ["7"], True)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontaminate_equals_brute_force(tables, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs = tables(DOCS, "doc_id long, text string").withColumn("words", F.lit("a clashing name"))
    items = tables(ITEMS, "item_id long, text string").withColumn("window", F.lit(0))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in D.decontaminate(docs, items).collect()]
    assert sorted(got, key=repr) == brute(DOCS, ITEMS)


def test_decontaminate_empty_tables(tables):
    docs, items = tables(DOCS, "doc_id long, text string"), tables(ITEMS, "item_id long, text string")
    assert D.decontaminate(docs.limit(0), items).count() == 0
    clean = D.decontaminate(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r["contaminated"] or r["n_hit"] for r in clean)


def host_path(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host):])[0]


def verdict(url, rules):
    host, path = host_path(url)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
           if h is not None and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/17?x#y", "ftp://org/", "http://example.org", "http://notexample.org/es/", None, "", "nonsense",
    "x://y://org/a", "http://", "http://b.com/fr/x", "http://com/de/", "http://b.com/De/", "http://b.com?/de/", "http://b.com:80/de/", "http://.org/", "http://a..org/x",
    "http://b.net/fr/", "http://exämple.org/es/é", "http://a.example.org/es/1", "http://x/" + "p/" * 5000, "http://" + "s." * 300 + "org/en/1",
]


@pytest.mark.parametrize("bloom", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_equal_brute_force(tables, monkeypatch, bloom, broadcast):
    if not broadcast:
        monkeypatch.setattr(U, "BROADCAST_KEYS", 0)
    rules = [*U.RULES, (None, "/", "block"), ("net", "", "block"), ("example.org", "/en/1", "block"), ("a.example.org", None, "block"), ("b.com", "/de", "allow")]
    pages = tables([(i if i % 7 else None, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("key", F.lit(1))
    got = U.judge_urls(pages, tables(rules, "host string, path string, verdict string"), bloom=bloom)
    want = [(i if i % 7 else None, *verdict(u, rules)) for i, u in enumerate(URLS)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_urls_empty_tables(tables):
    pages = tables([(1, "http://a.org/")], "page_id long, url string")
    rules = tables(list(U.RULES), "host string, path string, verdict string")
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in U.judge_urls(pages, rules.limit(0)).collect()] == [(1, "a.org", "/", None, "allow")]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 5000 * U.BITS_PER_KEY // 64
    bits = U.bloom_blocks(keys, blocks)
    asked = spark.range(10_000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("block", U._block(F.col("key"), blocks))
    through = asked.join(bits, "block").filter(F.col("bits").bitwiseAND(U._mask(F.col("key"))) == U._mask(F.col("key")))
    listed = through.filter("id < 5000").count()
    assert listed == 5000 and through.count() - listed < 250


def test_plans_have_no_python(spark):
    from placeweave.llm.queries import QUERIES

    for name in ("op6_decontaminate", "op8_url_filter"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin")), name


def test_digest_columns(spark):
    from placeweave.llm.queries import QUERIES

    row = QUERIES["op6_decontaminate"](spark, "/root/testdata/sf0.001").filter("n_items = 0").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()
