"""The same results in SQL, written for DuckDB and independent of the DataFrame code."""

from oracle.jobs import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
