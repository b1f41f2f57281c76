"""Stages of ingest and query, each from DataFrame to DataFrame."""
