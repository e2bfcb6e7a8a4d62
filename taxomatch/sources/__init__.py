"""Scans, sinks, weights file and vector cache."""
