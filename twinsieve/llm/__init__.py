"""Operators of a training-data pipeline: deduplication, filtering, mixing, packing and output.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
