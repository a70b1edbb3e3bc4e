"""Operators of a training-data pipeline. Nothing else in ``parley`` imports
this subpackage; its queries are added by ``__spark_entry__.py``."""
