"""Hybrid retrieval, citation joins and retrieval evaluation as Spark plans."""
