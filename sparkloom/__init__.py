"""Spark-native analytics over property graphs, text lines, findings and change history."""

from sparkloom.session import build_session, read_table

__all__ = ["build_session", "read_table"]
