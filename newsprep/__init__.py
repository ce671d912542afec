"""newsprep: news text to retrieval-augmented answers, as Spark DataFrame jobs."""

__version__ = "0.1.0"
