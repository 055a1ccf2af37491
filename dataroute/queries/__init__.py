"""Every operator as a query over the tables, with the same result in SQL."""

from dataroute.queries.spark_side import QUERIES
from dataroute.queries.sql_side import ORACLES

__all__ = ["ORACLES", "QUERIES"]
