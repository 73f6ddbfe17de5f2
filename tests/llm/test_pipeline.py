"""Each stage against a brute-force version, on its own input."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from placeweave.llm import quality as Q
from test_dedup import LAST_ID, gram_set, removed_brute, similar_brute
from test_filters import brute as contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        done = C.written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, done))
        docs = done
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_keep_the_columns(outputs):
    assert [n for n, _ in C.STAGES] == list(outputs) and len(outputs) == 5
    for name, (before, after) in list(outputs.items())[:-1]:
        assert after.dtypes == before.dtypes, name


def test_quality_stage(spark, outputs):
    before, after = outputs["quality"]
    model = Q.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    codes = Q._Codes()
    import numpy as np

    kept = [r for r in rows(before) if model.score(np.array([Q.term_counts(r[1] or "", codes)]))[0] >= Q.THRESHOLD]
    assert rows(after) == kept and 0 < len(kept) < before.count()


def test_near_duplicate_stage(outputs):
    before, after = outputs["near_duplicates"]
    docs = rows(before)
    stays = [d for d, (doc_id, n, c) in zip(docs, sorted(similar_brute(docs), key=repr), strict=True) if d[0] == doc_id and c == doc_id]
    assert rows(after) == sorted(stays, key=repr)


def test_repeats_stage(spark, outputs):
    before, after = outputs["repeats"]
    docs = rows(before)
    ties = {r["text"]: r["h"] for r in before.select("text", F.xxhash64("text").alias("h")).collect()}
    want = {d: (gone, kept) for d, _, gone, kept in removed_brute(docs, ties, 20)}
    old = dict(docs)
    assert rows(after) == sorted(((d, kept if gone else old[d]) for d, (gone, kept) in want.items()), key=repr)
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_decontamination_stage(spark, outputs):
    before, after = outputs["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    # Items are few windows; the brute force needs only documents that have a first word of one.
    bad = {d for d, _, _, _, contaminated in contamination(rows(before)[:60], items[:6]) if contaminated}
    kept = {d for d, _ in rows(after)}
    assert not bad & kept
    texts = dict(rows(before))
    gone = set(texts) - kept
    for d in gone:
        assert any(r[4] for r in contamination([(d, texts[d])], items))


def test_packing_stage(outputs):
    before, after = outputs["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_run_gives_the_last_stage(spark, outputs):
    columns = [c for c in outputs["packing"][1].columns if c != "sequence_id"]
    got = C.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(got) == sorted(outputs["packing"][1].select("doc_id", "piece", "ids_crc32").collect()) and columns


def test_stages_bear_odd_rows(spark):
    odd = [(None, None), (None, "a text without an id that is long enough to be scored"), (1, ""), (1, None), (2, "twice"), (2, "twice"), (3, "w " * 5000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in odd], "doc_id long, text string, __score string, key string")
    for name, stage in C.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns, name
        assert done.count() >= (1 if name == "quality" else 5), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    near = C.near_duplicates(spark, docs, SF).collect()
    assert [(r["doc_id"], r["text"]) for r in near].count((2, "twice")) == 1 and len(near) == 6


def test_all_eleven_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert gram_set("a") and LAST_ID > 0


def test_near_duplicates_drop_prefixes_before_sets_are_joined(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " end" for t in texts])], "doc_id long, text string")
    left, links = [], C.ngram_join.links_in_parts

    def seen(sets, parts):
        left.extend(p.name.rpartition("-")[0] for p in tmp_path.rglob("*") if p.is_dir())
        return links(sets, parts)

    monkeypatch.setattr(C.ngram_join, "links_in_parts", seen)
    monkeypatch.setattr("placeweave.llm.common.shared_folder", lambda _: str(tmp_path))
    kept = C.near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(30))
    assert "whole" in left and "rows" in left and not {"sets", "cells", "counts", "members"} & set(left)
