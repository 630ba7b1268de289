"""Reusable DataFrame operators: neighbours, latest reading, constraints, ingest, changes."""
