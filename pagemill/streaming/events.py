"""A run's events as messages, over a stream as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Kinds of steps whose messages have a name of their own; all others are steps.
NAMES = {"content-servers": "url-found", "done": "complete", "failed": "error"}


def messages(steps: DataFrame) -> DataFrame:
    """(event, data, ts) of steps (action, target, ts): the message's name, its data as JSON, and its time."""
    name = F.lit("step")
    for action, event in NAMES.items():
        name = F.when(F.col("action") == action, event).otherwise(name)
    return steps.select(name.alias("event"), F.to_json(F.struct("action", "target")).alias("data"), F.col("ts").cast("long").alias("ts"))


def broadcast(steps: DataFrame, send: Callable[[list[str]], None], checkpoint: str, most: int = 10_000) -> StreamingQuery:
    """Send each micro-batch's messages, as JSON in order of time, ``most`` at a time."""

    def each(batch: DataFrame, _: int) -> None:
        held = []
        for r in batch.orderBy("ts").select(F.to_json(F.struct("event", "data", "ts")).alias("m")).toLocalIterator():
            held.append(r["m"])
            if len(held) == most:
                send(held)
                held = []
        if held:
            send(held)

    return messages(steps).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
