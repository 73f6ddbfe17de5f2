"""Queries: quality classifier and packing."""

from pyspark.sql import functions as F

from placeweave.llm import packing as P
from placeweave.llm import quality as Q
from placeweave.llm.registry import query, table


@query()
def op7_quality(spark, sf_dir):
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Q.fit(docs, table(spark, sf_dir, "labels"))
    scored = Q.score(docs.withColumn("held_out", Q.held_out("doc_id")), model)
    return scored.select(
        "doc_id", "held_out", F.col("quality_score").alias("score"),
        (F.col("quality_score") >= Q.THRESHOLD).cast("int").alias("predicted"))


@query()
def op9_packing(spark, sf_dir):
    """All documents in sequences of 1024 tokens."""
    return P.pack(table(spark, sf_dir, "documents"))
