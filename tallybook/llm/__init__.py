"""Operators for preparing training text: packing, language id, sharding, toxicity,
weak-supervision quality, exact and fuzzy dedup, source mixing, license search.

Nothing outside this subpackage imports it.
"""
