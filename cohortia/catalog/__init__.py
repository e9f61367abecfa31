"""Demonstration queries over the driver tables, one module per operator family."""
