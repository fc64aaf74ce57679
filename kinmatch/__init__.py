"""kinmatch: catalogue deduplication and entity-resolution analytics on PySpark."""

__version__ = "0.1.0"
