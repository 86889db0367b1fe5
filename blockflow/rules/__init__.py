"""Lexicons, patterns and thresholds kept as data."""
