"""Test adapters: clinical views over the supplied tables, DuckDB oracle SQL,
and the query registry used by ``__spark_entry__``."""
