"""Operators of a training-data pipeline: archive, tokenise, decontaminate, deduplicate, filter.

Nothing else in the library imports this subpackage.
"""
