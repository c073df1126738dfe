"""Corpus operators for training-data pipelines. Nothing else in `strata` imports this subpackage."""
