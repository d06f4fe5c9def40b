"""loomstat: a Spark-first engine for tabular statistics and classical machine learning."""

__version__ = "0.1.0"
