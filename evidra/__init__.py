"""Evidence-graph analytics as ordinary PySpark DataFrame jobs."""

__version__ = "0.1.0"
