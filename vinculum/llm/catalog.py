"""All dealt queries, registered by importing their modules."""

from vinculum.llm import chat_format, decontaminate, filter_audit, hard_negatives, jaccard_join, language_id, packing, pii, quality_classifier, quality_rules, secret_scan, suffix_dedup, toxicity  # noqa: F401
from vinculum.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
