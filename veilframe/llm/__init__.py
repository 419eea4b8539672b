"""Operators that prepare training text: mixing, sharding, scoring, deduplication, checks."""
