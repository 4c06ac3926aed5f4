"""Operators for preparing training text at scale: packing, deduplication, filtering, extraction."""
