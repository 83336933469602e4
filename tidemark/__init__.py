"""tidemark: declared answers over event streams, kept current with Spark."""

__version__ = "0.1.0"
