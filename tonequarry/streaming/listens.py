"""The listen tracker: raw player events become one departure per track, in a stream or in a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import recorded
from ..sources.tables import PLAYER_EVENTS

DEPARTURE = "listener bigint, ts timestamp, song_id bigint, played_ms bigint, duration_ms bigint"
_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("song_id", "duration_ms", "furthest")])


class Tracker:
    """Started closes the track before; progress keeps the furthest position; finished emits, once."""

    def __init__(self, song: int | None = None, duration: int = 0, furthest: int = 0) -> None:
        self.song, self.duration, self.furthest = song, duration, furthest

    def _leave(self) -> tuple[int, int, int] | None:
        out = None if self.song is None else (self.song, self.furthest, self.duration)
        self.song, self.duration, self.furthest = None, 0, 0
        return out

    def on(self, kind: str, song: int | None, position: int | None, duration: int | None) -> tuple[int, int, int] | None:
        """The departure (song, furthest position, duration) that the event brings about, if any."""
        out = None
        if kind == "started":
            out = self._leave()
            self.song, self.duration = song, max(0, duration or 0)
        elif self.song is not None:
            self.furthest = max(self.furthest, position or 0)
            if duration and duration > 0:
                self.duration = duration
            if kind == "finished":
                out = self._leave()
        return out


class TrackerProcessor(StatefulProcessor):
    """The tracker of each listener. Events of a batch are taken in the order of their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("track", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        tracker = Tracker(*held) if held is not None else Tracker()
        for r in sorted(rows, key=lambda r: (r["ts"], ("finished", "progress", "started").index(r["kind"]))):
            left = tracker.on(r["kind"], r["song_id"], r["position_ms"], r["duration_ms"])
            if left is not None:
                yield Row(listener=key[0], ts=r["ts"], song_id=left[0], played_ms=left[1], duration_ms=left[2])
        if tracker.song is None:
            self.state.clear()
        else:
            self.state.update((tracker.song, tracker.duration, tracker.furthest))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def player_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PLAYER_EVENTS).parquet(path)


def track_listens(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Departures of a stream of player events; events later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy("listener").transformWithState(TrackerProcessor(), DEPARTURE, "Append", "None")


def departures(events: DataFrame) -> DataFrame:
    """The batch twin: events between one start and the next are a visit, which ends at its finish or at that start."""
    order = Window.partitionBy("listener").orderBy("ts", F.array_position(F.array(F.lit("finished"), F.lit("progress"), F.lit("started")), F.col("kind")))
    visits = events.withColumn("visit", F.sum((F.col("kind") == "started").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("visit") > 0)
    in_visit = Window.partitionBy("listener", "visit")
    ends = F.min(F.when(F.col("kind") == "finished", F.struct("ts"))).over(in_visit)
    # What comes after a finish belongs to no track.
    visits = visits.withColumn("end", ends["ts"]).where(F.col("end").isNull() | (F.col("ts") <= F.col("end")))
    by = visits.groupBy("listener", "visit").agg(
        F.max(F.when(F.col("kind") == "started", F.col("song_id"))).alias("song_id"),
        F.max(F.when(F.col("kind") == "started", F.lit(0)).otherwise(F.coalesce("position_ms", F.lit(0)))).cast("bigint").alias("played_ms"),
        F.max_by(F.when(F.col("duration_ms") > 0, F.col("duration_ms")), F.when(F.col("duration_ms") > 0, F.col("ts"))).alias("duration_ms"),
        F.max("end").alias("end"),
        F.min("ts").alias("start"),
    )
    closing = F.lead("start").over(Window.partitionBy("listener").orderBy("visit"))
    return by.withColumn("ts", F.coalesce("end", closing)).where(F.col("ts").isNotNull()).select("listener", "ts", "song_id", F.greatest(F.lit(0).cast("bigint"), "played_ms").alias("played_ms"), F.coalesce("duration_ms", F.lit(0).cast("bigint")).alias("duration_ms"))


def fan_out(departed: DataFrame, steer, history_path: str, checkpoint: str, once: bool = True):
    """Every departure goes to steer(batch), those long enough to the history as well, from one query."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        steer(batch)
        recorded(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(history_path)
        batch.unpersist()

    writer = departed.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sessions(listens: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sittings of a listener: listens no further apart than the gap. Works on streams and on batches."""
    rows = listens.withWatermark("ts", late) if listens.isStreaming else listens
    by = rows.groupBy("listener", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("listens"), F.sum("played_ms").alias("played_ms")).select("listener", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "listens", "played_ms")
