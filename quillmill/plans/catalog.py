"""Registry of the engine's named queries and their oracle SQL."""

from __future__ import annotations

from quillmill.plans import corpus_queries, engine_queries, extended_queries, fixture_queries

MODULES = (corpus_queries, engine_queries, fixture_queries, extended_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
#: Queries that are timed.
HEADLINE = [
    "doc_token_stats", "clean_documents", "exact_dedup", "near_duplicates", "quality_report", "split_sequences", "train_val_split", "passage_chunks", "document_keywords", "keyword_search", "corpus_verify",
    "claims", "store_lookup", "lite_signals", "agreement", "convergence", "calibration_error", "chat_format", "review_merge", "manifest_summary", "cross_source_duplicates", "knn", "stream_tumbling",
]
