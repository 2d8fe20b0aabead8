"""Operators of a training-data pipeline: cleaning, de-duplication, packing and formatting of text tables."""
