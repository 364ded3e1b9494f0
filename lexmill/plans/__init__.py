"""Query registry and plans."""


def load() -> None:
    """Imports every module that registers queries."""
    from . import answering_queries, cleaning_queries, crawl_queries, curation_queries, document_queries, embedding_queries, evidence_queries, predicate_queries, ranking_queries, repair_queries, retrieval_queries, routing_queries, source_queries, text_queries, triage_queries  # noqa: F401
