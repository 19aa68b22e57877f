"""The event log as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from veridag.functions.numbers import rounded
from veridag.functions.text import sorted_json
from veridag.operators.log import concept_edges


def deduplicated(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once, by id, within the watermark's lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events and their mean value per window and type; append mode emits a window once the watermark has passed it."""
    w = F.window("ts", width)
    found = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value"), 6).alias("mean_value"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def closed_windows(events: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """windowed_counts of each event once, by id: in append mode, a window comes when the watermark has passed its end.

    An event is late when it is older than the watermark of the batch before, even if its window is open, as its first copy
    can't be known any more; LateRows counts those.
    """
    once = deduplicated(events, lateness)
    found = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value"), 6).alias("mean_value"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


class LateRows(StreamingQueryListener):
    """Counts, of each query that it sees, the rows that came after the watermark had passed them and were left out."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802  the names are Spark's
        progress = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators if s.operatorName == "dedupeWithinWatermark")
        self.rows[str(progress.id)] = self.rows.get(str(progress.id), 0) + late

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def appended_epochs(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that appends to tables under path what each function makes of a batch.

    A batch owns a folder a table, named by its epoch, and writes it whole: a batch that is run again after a failure puts
    the same rows in the same place, so that the tables hold each batch once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, made in tables.items():
            made(batch).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
        batch.unpersist()

    return run


def append_events(events: DataFrame, maps_to: DataFrame, path: str, lateness: str = "1 hour") -> DataStreamWriter:
    """The stream that appends events (event_id, event_type, ts, ingested_at, curies, payload) to the log under path, once by
    id, with ABOUT edges to the entities (label, id) that their curies map to: start() it with a checkpoint.

    Edges come from a join of the batch with maps_to (curie, label, id), as that is when the batch runs.
    """
    now = F.current_timestamp()
    told = lambda b: b.select("event_id", "event_type", F.col("ts").alias("occurred_at"), F.coalesce("ingested_at", now).alias("ingested_at"), sorted_json(F.col("payload")).alias("payload"))
    about = lambda b: concept_edges(b, "event_id", "curies", maps_to, "ABOUT")
    once = deduplicated(events, lateness)
    return once.writeStream.foreachBatch(appended_epochs(path, {"events": told, "about": about}))


CLOSES = T.StructType([T.StructField("key", T.LongType()), T.StructField("decision_id", T.LongType()), T.StructField("closed_at", T.TimestampType())])


class ClosesDecisions(StatefulProcessor):
    """Of a key's decisions, when each is closed by the next one: what came since the watermark waits until nothing can
    come before it any more, and then the open decision is closed by it and it is the open one.

    The first that waits has a timer; one that expires takes all that is ready and sets that of the first of the rest, so
    that a key's waiting decisions are read once a batch and not once a decision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = "at long, decision_id long"  # microseconds
        self.handle, self.open = handle, handle.getValueState("open", pair)
        self.waiting = handle.getListState("waiting", pair)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        first = None
        for b in rows:
            at = b["valid_from"].astype("datetime64[us]").astype("int64").tolist()
            if at:
                self.waiting.appendList(list(zip(at, b["decision_id"].tolist())))
                first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame(columns=CLOSES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        ready = [x for x in waiting if x[0] <= sure]
        out = []
        if ready:
            held = self.open.get()
            chain = [tuple(held), *ready] if held else ready
            out = [(key[0], d, pd.Timestamp(t, unit="us")) for (_, d), (t, _) in zip(chain, chain[1:])]
            self.open.update(chain[-1])
            rest = waiting[len(ready) :]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
        yield pd.DataFrame(out, columns=CLOSES.names).astype({"closed_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def closed_decisions(decisions: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream of close records (key, decision_id, closed_at) from a stream of decisions (key, decision_id, valid_from).

    Rows may come out of order by up to `lateness`; later ones are left out.  The records belong to superseded(): a
    decision is valid until its key's next one begins.  Needs the RocksDB state store (see with_rocksdb).
    """
    late = decisions.withWatermark("valid_from", lateness)
    return late.groupBy("key").transformWithStateInPandas(ClosesDecisions(), CLOSES, "Append", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for queries that are started meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def late_arrivals(events: DataFrame, occurred: str, ingested: str, limit: str) -> DataFrame:
    """Events that came later than the limit after they occurred."""
    return events.where(F.col(ingested) > F.col(occurred) + F.expr(f"interval {limit}"))


def automations(rules: list[tuple[str, Column, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], DataFrame]:
    """A foreachBatch body: each (name, predicate, handler) runs on its rows of a batch.

    It returns a row per automation with the rows it got and its error, if any; one that fails doesn't stop the others.
    """

    def run(batch: DataFrame, epoch: int) -> DataFrame:
        log = []
        batch.persist()
        for name, predicate, handler in rules:
            try:
                log.append((epoch, name, handler(batch.where(predicate)).count(), None))
            except Exception as e:  # noqa: BLE001  any handler error belongs in the log
                log.append((epoch, name, 0, f"{type(e).__name__}: {e}"[:500]))
        batch.unpersist()
        return batch.sparkSession.createDataFrame(log, "epoch long, automation string, rows long, error string")

    return run
