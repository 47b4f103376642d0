"""Quillon: findings analytics and corpus preparation as declarative PySpark plans."""

from quillon.session import configure, staged

__all__ = ["configure", "staged"]
