"""tidemark: behaviour analytics and corpus preparation as plain Spark jobs."""

__version__ = "0.3.0"
