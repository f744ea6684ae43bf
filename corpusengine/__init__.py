"""corpusengine: document-corpus ingestion and retrieval as Spark DataFrame
operators (see README.md for the layout and the operator inventory)."""

__version__ = "0.1.0"
