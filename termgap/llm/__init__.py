"""Operators for training-data pipelines: scoring, deduplication, decontamination, token counts, packing and token files."""
