"""Queries over packed log fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import latest_by, unpack
from ..session import table

#: field, table, key and time column of each packed field.
FIELDS = (
    ("result_files", "query_history", "query_id", "logged_at"),
    ("manual_files", "session_feedback", "feedback_id", "logged_at"),
    ("edited_files", "active_sessions", "session_id", "last_seen"),
)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per path in the three packed log fields."""

    def one(field: str, name: str, key: str, time: str) -> DataFrame:
        rows = latest_by(table(spark, sf_dir, name), [key], [time], [field])
        keyed = rows.select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("row_key"), field)
        return unpack(keyed, field, value="file_path", keep=["field_name", "row_key"])

    return reduce(DataFrame.unionByName, [one(*x) for x in FIELDS])


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
