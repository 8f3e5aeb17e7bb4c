"""Operators of a large-scale training-data pipeline (one module per operator)."""
