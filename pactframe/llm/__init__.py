"""Operators for preparing training text: cleaning, dedup, scans, encoding, formatting."""
