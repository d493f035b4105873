"""Landed payloads of the retailers, and files, as tables of offers."""
