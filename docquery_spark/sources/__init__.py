"""Scans that yield raw chunks or document tables."""
