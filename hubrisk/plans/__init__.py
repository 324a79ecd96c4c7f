"""Query plans: the registered queries (Spark) and their DuckDB oracle SQL."""
