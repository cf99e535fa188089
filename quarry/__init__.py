"""quarry: a Spark-native corpus, retrieval and table-answer engine.

Everything is a DataFrame -> DataFrame transformation; see README.md for the
operator map.
"""

__version__ = "0.1.0"
