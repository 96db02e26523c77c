"""Vitrine: batch search, similarity and enrichment of item collections on Spark.

Every operator takes DataFrames and returns a DataFrame.  A table of queries is
ranked against a corpus table; one interactive query is the one-row case.
"""

__version__ = "0.1.0"
