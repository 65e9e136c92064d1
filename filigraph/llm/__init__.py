"""Corpus operators for training-data pipelines.

Self-contained: nothing outside this folder imports it.  Each module is one
operator with a general interface; ``queries`` holds the registered queries
and their SQL.
"""
