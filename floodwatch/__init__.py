"""Flood detection, entropy analysis, mitigation and reporting as Spark jobs."""
