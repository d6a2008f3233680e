"""lexweave: documents to a knowledge graph, as Spark DataFrame operations."""

__version__ = "0.1.0"
