"""All queries of the subpackage. Importing the modules registers them."""

from placeweave.llm import q_archives, q_conversations, q_counts, q_dedup, q_filters, q_private, q_text  # noqa: F401
from placeweave.llm.registry import ORACLES, QUERIES  # noqa: F401
