"""Query plans: join helpers, the query registry and its DuckDB oracle SQL."""
