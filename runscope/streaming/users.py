"""User creation as a stream: clean the username, log what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.identity import has_slash, sanitize_username


def cleaned_users(users: DataFrame) -> DataFrame:
    """Rows with a clean username, the one they came with, and whether it changed (stateless, batch or stream)."""
    return users.select(
        *[c for c in users.columns if c != "username"],
        F.col("username").alias("original_username"),
        sanitize_username("username").alias("username"),
        F.coalesce(has_slash("username"), F.lit(False)).alias("username_changed"),
    )


def write_cleaned_users(users: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends cleaned users to ``path`` as they arrive; ``checkpoint`` must be on shared storage."""
    return (
        cleaned_users(users)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
