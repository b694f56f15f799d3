"""Registered queries: each module has QUERIES (name -> callable(spark, sf_dir)) and SQL (name -> DuckDB text)."""
