"""Scans of the raw inputs (CSV, HTML, JSON, Markdown) and the catalog sink."""
