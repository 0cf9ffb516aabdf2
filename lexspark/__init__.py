"""lexspark: retrieval, citation-graph and answer-quality analytics as Spark jobs."""

__version__ = "0.1.0"
