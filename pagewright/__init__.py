"""pagewright: captured-page processing on Spark.

Tables and streams of captured pages, request logs and failure records are
turned into clean, queryable data with DataFrame / SQL operators and
Structured Streaming.  Sub-packages:

* ``sources``   – readers, fixture views over the driver tables, sinks
* ``functions`` – Column expressions (URLs, text cleaning, dates, errors)
* ``operators`` – DataFrame -> DataFrame operators (links, articles,
  failures, rates, statistics, ordered folds)
* ``plans``     – the registered query catalogue and its DuckDB oracle SQL
* ``streaming`` – Structured Streaming versions of the operators
"""

__all__ = ["session"]
