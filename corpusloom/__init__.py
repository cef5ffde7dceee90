"""Web-corpus collection and analysis as PySpark DataFrame transforms."""

__version__ = "0.1.0"
