"""Operators of a training-data pipeline: tokenisers, scans, near-duplicates, archives.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames;
``queries`` binds each of them to the tables it is meant for.
"""
