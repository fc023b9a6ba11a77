"""Independent DuckDB SQL for every registered query (the correctness oracle).

Only the driver's raw tables exist as views on the DuckDB side, so every
statement starts with the fixture mapping as CTEs (``mk_*``) and then follows
the shape of the original SQL, written in DuckDB's dialect with the same
rounding rule, NULL-safe division and explicit output types as the Spark plans.
"""

from tianguis.oracle.queries_sql import oracle_queries

__all__ = ["oracle_queries"]
