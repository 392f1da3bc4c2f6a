"""ragframe: retrieval and document analytics as set-at-a-time Spark jobs."""

__version__ = "0.1.0"
