"""Findings from a stream of reports."""
