"""Fixture bindings, the query catalogue and their DuckDB oracles."""
