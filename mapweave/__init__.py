"""Spark-native analytics for mapping a public issue over the web."""

from mapweave.session import build_session, materialize

__all__ = ["build_session", "materialize"]
