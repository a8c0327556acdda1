"""Streams into tables: every micro-batch commits once, whatever is repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.table.table import Table


def append_batch(table: Table, batch: DataFrame, query: str, batch_id: int) -> bool:
    """Append a micro-batch unless the table has it; True if it was appended.

    The table's state keeps the last batch of each query, whatever snapshots are expired, and the commit itself tests it: a batch that is
    run again, even beside the first attempt, is not appended twice. One query name belongs to one stream.
    """
    if table.last_batch(query) >= batch_id:
        return False
    with table.new_transaction().begin() as t:
        t.append_df(batch).set_summary(**{"stream-query": query, "stream-batch": batch_id}).once(query, batch_id)
    return t.published


def stream_into(stream: DataFrame, table: Table, checkpoint: str, query: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that appends ``stream`` to ``table``; ``checkpoint`` is its state folder. With ``available_now`` it ends when the input there is at the start is exhausted."""
    writer = stream.writeStream.foreachBatch(lambda df, i: append_batch(table, df, query, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _closed(rows: DataFrame, folder: str, schema: str) -> DataFrame:
    """Runs a stream of groups that its watermark closes until its input is exhausted, and gives the written result."""
    query = rows.writeStream.outputMode("append").option("checkpointLocation", folder + "-state").format("parquet").option("path", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(folder)


def windowed_counts(stream: DataFrame, folder: str, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per window and event type of what the stream has now: start, event_type, n, for windows the watermark has closed.

    Windows follow each other, or begin every ``slide``.
    """
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _closed(counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), folder, "start timestamp_ntz, event_type string, n long")


def session_counts(stream: DataFrame, folder: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, which end after a ``gap`` without rows, of what the stream has now: key, start, n, for those the watermark has closed."""
    counted = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    kind = stream.schema[key].dataType.simpleString()
    return _closed(counted.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), folder, f"{key} {kind}, start timestamp_ntz, n long")


def latest_per_key(stream: DataFrame, key: str, value: str, folder: str) -> DataFrame:
    """The largest value and the number of rows of each key of what the stream has now: key, latest, n.

    State of one pair of numbers per key is kept between micro-batches; every batch writes the keys it
    changed with their new state, and the result takes the furthest state of each key. Null keys are left out.
    """

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latest, n = state.get if state.exists else (None, 0)
        for f in frames:
            top = int(f[value].max())
            latest, n = top if latest is None else max(latest, top), n + len(f)
        state.update((latest, n))
        yield pd.DataFrame({key: [keys[0]], "latest": [latest], "n": [n]})

    schema = f"{key} long, latest long, n long"
    changed = stream.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).applyInPandasWithState(update, schema, "latest long, n long", "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a repeated batch replaces itself

    query = changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = stream.sparkSession.read.schema(schema + ", batch int").parquet(folder)
    return states.groupBy(key).agg(F.max("latest").alias("latest"), F.max("n").alias("n"))
