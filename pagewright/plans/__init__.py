"""The registered query catalogue (``catalog``) and its DuckDB oracle SQL (``oracle``)."""
