"""Structured Streaming in front of the circuit and the store, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..incremental import Circuit, Journal
from ..store import Store


def ticking(circuit: Circuit, publish: Callable[[DataFrame, int], None] | None = None, journal: Journal | None = None, last: int = -1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch of ``op, s, p, o`` (``op`` 1 or -1) is a tick.

    A batch that is delivered again is known by its number and left out. With a journal its changes are
    written before they are applied, so that a restarted driver (``Journal.resume`` gives the circuit
    and ``last``) goes on where it was: the last batch, which may not have been published, is published again
    under its number, and no batch counts twice.
    """
    done = {"last": last}

    def run(batch: DataFrame, number: int) -> None:
        if number <= done["last"]:
            if publish and journal and number == last and circuit.feed:
                publish(circuit.feed[-1], number)
            return
        changes = batch.select("s", "p", "o", F.col("op").cast("long").alias("mult"))
        circuit.log(journal.append(number, changes) if journal else changes)
        out = circuit.tick()
        if publish:
            publish(out, number)
        done["last"] = number
        if journal and (number + 1) % journal.every == 0:
            journal.checkpoint(circuit, number)
            journal.tidy()

    return run


def storing(store: Store) -> Callable[[DataFrame, int], None]:
    """The same for quads: a batch is one version, and applying it twice is applying it once."""

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("g", "s", "p", "o").agg(F.max_by("op", "seq").alias("op"))
        store.apply(last.where("op = -1"), last.where("op = 1"))

    return run


def start(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a handler over a stream; ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events by type in windows of event time; with ``late``, rows later than the watermark are dropped (streams)."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
