"""Readers, writers, the three-table bundle and adapters over the demo tables."""
