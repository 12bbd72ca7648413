"""Orewright: a Spark-native engine for data mining over very large tables.

Every operator takes DataFrames and returns DataFrames; randomness always comes from an explicit seed.
"""

__version__ = "0.1.0"
