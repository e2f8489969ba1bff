"""arborq: a PySpark-native query engine for structured documents."""

__version__ = "0.1.0"
