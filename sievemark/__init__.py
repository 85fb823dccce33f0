"""Evidence-first search and analysis of text corpora, as Spark DataFrame operations."""

__version__ = "0.1.0"
