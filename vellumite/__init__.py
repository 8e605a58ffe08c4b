"""Query and patch large corpora of structured documents on Spark."""

__version__ = "0.1.0"
