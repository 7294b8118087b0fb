"""Append sinks. Each batch owns its folders, so a repeated batch replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_batch(df: DataFrame, root: str, table: str, batch: int | str, partition_by: list[str] | None = None) -> str:
    """Write one batch of a table idempotently."""
    path = f"{root.rstrip('/')}/{table}/stream_batch={batch}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_failures(messages: DataFrame, root: str, batch: int | str) -> str:
    """Message ids to deliver again, one row per id."""
    failed = messages.where("failed").groupBy("message_id").agg(F.min("msg_pos").alias("first_pos"))
    return write_batch(failed, root, "item_failures", batch)


def write_routed(routed: DataFrame, root: str, batch: int | str) -> None:
    """Split routed deliveries into one folder per destination in one pass."""
    write_batch(routed.where("destination <> 'acknowledged'"), root, "undelivered", batch, ["destination"])


def write_telemetry(events: DataFrame, root: str, batch: int | str) -> str:
    dated = events.withColumn("event_date", F.to_date("ts"))
    return write_batch(dated, root, "telemetry", batch, ["event_date"])
