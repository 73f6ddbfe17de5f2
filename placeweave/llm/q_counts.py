"""Queries: token counts and licence scans."""

from placeweave.llm import license_scan, token_counts
from placeweave.llm.registry import query, table


@query()
def op3_token_counts(spark, sf_dir):
    """Every document's words and greedy longest-match tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query()
def op5_license_scan(spark, sf_dir):
    """Licence notices in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))
