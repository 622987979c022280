"""Scans, sinks and the study views over the given tables."""
