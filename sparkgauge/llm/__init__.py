"""Operators for large text corpora used as training data.

Nothing outside this folder imports it.  ``entries`` holds the queries that
``__spark_entry__`` registers when this folder is present.
"""
