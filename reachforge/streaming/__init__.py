"""Continuous ingestion; an extension beyond the batch operators."""
