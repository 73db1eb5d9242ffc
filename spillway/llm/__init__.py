"""Operators for training-data corpora: tokenising, filtering, de-duplication, archives, packing.

Nothing outside this package imports it. :mod:`spillway.llm.queries` registers one query per operator.
"""
