"""Spark-native financial time-series analytics.

Operators are plain functions ``DataFrame -> DataFrame``; they take the data
first and everything else by keyword, so they compose with ``df.transform``.
"""

__version__ = "0.1.0"
