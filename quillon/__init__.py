"""Quillon: a PySpark-native analytics engine with PostgreSQL-flavoured semantics."""

__version__ = "0.1.0"
