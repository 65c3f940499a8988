"""Relevance-ranked, token-budgeted context retrieval as Spark DataFrame operators."""
