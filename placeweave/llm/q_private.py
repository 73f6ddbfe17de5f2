"""Query: personal data."""

from pyspark.sql import functions as F

from placeweave.llm import private_data as P
from placeweave.llm.registry import query, table


@query()
def op13_private(spark, sf_dir):
    """Every document's personal data: what the rules find, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = P.find_spans(docs, P.fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in P.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
