"""Full-text retrieval and term statistics as Spark plans."""

__version__ = "0.1.0"
