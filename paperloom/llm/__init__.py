"""Operators for training-data pipelines, one module a problem.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
