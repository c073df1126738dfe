"""Structured Streaming forms of ingestion."""

from strata.streaming.ingest import ingest

__all__ = ["ingest"]
