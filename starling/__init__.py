"""Spark-native vector collections and analytics.

Collections are ordinary DataFrames with the columns ``id STRING, vector
ARRAY<FLOAT>, metadata STRING`` (JSON). Everything is declared with DataFrame
operations so Catalyst plans it; the one exception is a numpy distance kernel
behind ``mapInArrow`` for joins of many queries with many vectors.
"""

__version__ = "0.1.0"
