"""gridweave: rule-driven web-table extraction as Spark DataFrame jobs."""

__version__ = "0.1.0"
