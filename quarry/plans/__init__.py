"""Query catalogue, DuckDB oracle SQL, plan inspection and size guards."""
