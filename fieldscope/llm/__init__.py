"""Operators of a large-scale training-data pipeline (token counts, packing, filters, near-dedup, ...).

Nothing else in fieldscope imports this subpackage.
"""
