"""Column expressions."""

from strata.functions.columns import audit, blank_to_null, canonical_name, day_flag, standardize

__all__ = ["audit", "blank_to_null", "canonical_name", "day_flag", "standardize"]
