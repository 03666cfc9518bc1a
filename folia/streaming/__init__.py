"""Continuous ingestion of PDF files."""
