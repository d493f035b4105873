"""Relational operators of the comparison: relevance, per-store choice, dedupe, time-based state."""
