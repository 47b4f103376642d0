"""Whole queries: reports and the named queries of the entry module."""
