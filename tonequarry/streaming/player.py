"""What players report, as the tracker's events, and the pace at which streams are looked at. All work on streams and on batches."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def normalised(callbacks: DataFrame) -> DataFrame:
    """The tracker's events (listener, ts, kind, song_id, position_ms, duration_ms) of a player's callbacks.

    callbacks: listener, ts, callback, song_id, position_ms, duration_ms. A jump tells the position that was left; a
    transition starts its song or, without one, finishes the last; ready and a pause tell position and length; the
    end counts as the whole track; a closed player tells its position and finishes. Lengths that are null or negative
    are unset, 0. Other callbacks tell nothing.
    """
    callback, length = F.col("callback"), F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0))).cast("bigint")
    none = F.lit(0).cast("bigint")
    moved = callback == "transition"
    kind = (
        F.when(moved & F.col("song_id").isNotNull(), "started")
        .when(moved | callback.isin("ended", "closed"), "finished")
        .when(callback.isin("jump", "ready", "pause"), "progress")
    )
    position = F.when(moved, none).when(callback == "ended", length).otherwise(F.coalesce("position_ms", none))
    told = F.when(callback.isin("jump", "ended"), none).otherwise(length)
    return callbacks.select("listener", "ts", kind.alias("kind"), "song_id", position.alias("position_ms"), told.alias("duration_ms")).where(F.col("kind").isNotNull())


def _late(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def _newest(rows: DataFrame, span: Column, keys: list[str], values: list[str]) -> DataFrame:
    """The newest row of each span; among rows of one time, the largest."""
    last = F.max(F.struct("ts", *values)).alias("last")
    return rows.groupBy(*keys, span.alias("__span")).agg(last).select(*keys, "last.*")


def debounced(rows: DataFrame, keys: list[str], values: list[str], quiet: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Rows that no other of their key follows before the quiet time is over; each newer one cancels the one before."""
    return _newest(_late(rows, late), F.session_window("ts", quiet), keys, values)


def throttled(rows: DataFrame, keys: list[str], values: list[str], every: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """At most one row, the newest, of a key in each interval."""
    return _newest(_late(rows, late), F.window("ts", every), keys, values)


class DayProcessor(StatefulProcessor):
    """The first row of each day of a key. A day is remembered until the watermark passes the midnight after it: a timer forgets it then."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", T.StructType([T.StructField("day", T.StringType())]), T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: r["__at"]):
            if r["__until"] <= timerValues.getCurrentWatermarkInMs() or self.days.containsKey((r["__day"],)):
                continue
            self.days.updateValue((r["__day"],), (r["__until"],))
            self.handle.registerTimer(r["__until"])
            yield Row(**dict(zip(self.keys, key, strict=True)), day=r["__day"], at=r["__at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        midnight = expiredTimerInfo.getExpiryTimeInMs()
        for day, until in list(self.days.iterator()):
            if until[0] <= midnight:
                self.days.removeKey(day)
        yield from ()

    def close(self) -> None:
        pass


def days_begun(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, day, ts): a key's first row after each midnight of the session's time zone, when its playlist is to be rebuilt.

    As a stream it comes out when the row does, in append mode; of rows that overtake each other, the first to come counts. What
    comes after the watermark has passed the end of its day is left out. Needs the state store of listens.use_rocksdb.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    if not rows.isStreaming:
        return rows.groupBy(*keys, day.alias("day")).agg(F.min("ts").alias("ts"))
    midnight = F.date_add(F.to_date("ts"), 1).cast("timestamp")
    told = rows.withWatermark("ts", late).select(*keys, "ts", day.alias("__day"), F.unix_millis("ts").alias("__at"), F.unix_millis(midnight).alias("__until"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = told.groupBy(*keys).transformWithState(DayProcessor(keys), f"{fields}, day string, at bigint", "Append", "EventTime")
    return found.select(*keys, "day", F.timestamp_millis("at").alias("ts"))


def analysed_by_folder(analysed: DataFrame, songs: DataFrame) -> DataFrame:
    """(folder, analysed): live counts while tracks are analysed; songs is the library at rest, and a track counts once."""
    return analysed.select("song_id").dropDuplicates(["song_id"]).join(songs.select("song_id", "folder"), "song_id").groupBy("folder").agg(F.count(F.lit(1)).alias("analysed"))


EVERY_MS = 500
_PLAYING = T.StructType([*(T.StructField(n, T.LongType()) for n in ("at", "song_id", "position_ms", "duration_ms")), T.StructField("playing", T.BooleanType())])
_TICK = "listener bigint, ts timestamp, kind string, song_id bigint, position_ms bigint, duration_ms bigint"


def ticks(span: Column, position: Column, length: Column, every: int = EVERY_MS) -> Column:
    """How many samples fall into a span of ms that plays from a position: those before its end, none past a known length."""
    left = F.when(length > 0, F.floor((length - position) / every)).otherwise(F.lit(None))
    return F.greatest(F.lit(0), F.least(F.floor((span - 1) / every), left)).cast("bigint")


def sampled(states: DataFrame, every: int = EVERY_MS) -> DataFrame:
    """The tracker's progress events, one for each interval that a track plays: (listener, ts, kind, song_id, position_ms, duration_ms).

    states: listener, ts, song_id, position_ms, duration_ms, playing, a row whenever the player starts, stops, jumps or
    goes on. Samples lie between a state that plays and the listener's next one, so the last state has none yet, and end
    with the track if its length is known (above 0). Works on streams, where samples come with the next state and one that
    comes after a later one of its listener counts no more, and on batches.
    """
    length = F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0))).cast("bigint")
    rows = states.select("listener", "ts", "song_id", F.coalesce("position_ms", F.lit(0)).cast("bigint").alias("position_ms"), length.alias("duration_ms"), F.coalesce("playing", F.lit(False)).alias("playing"))
    if rows.isStreaming:
        return rows.groupBy("listener").transformWithState(SampleProcessor(every), _TICK, "Append", "None")
    following = F.lead("ts").over(Window.partitionBy("listener").orderBy("ts", "playing", "song_id"))
    spans = rows.withColumn("__span", F.unix_millis(following) - F.unix_millis("ts")).where(F.col("playing") & F.col("__span").isNotNull())
    n = ticks(F.col("__span"), F.col("position_ms"), F.col("duration_ms"), every)
    each = spans.withColumn("__n", n).where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    ts = F.timestamp_micros(F.unix_micros("ts") + F.col("__k") * every * 1000)
    return each.select("listener", ts.alias("ts"), F.lit("progress").alias("kind"), "song_id", (F.col("position_ms") + F.col("__k") * every).alias("position_ms"), "duration_ms")


class SampleProcessor(StatefulProcessor):
    """The stream of sampled(): a listener's last state is kept, and the next one brings out the samples between them."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("playing", _PLAYING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.state.get() if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r["ts"], r["playing"], r["song_id"] if r["song_id"] is not None else -(1 << 63))):
            at = round(r["ts"].timestamp() * 1_000_000)
            if last is not None and at < last[0]:
                continue
            if last is not None and last[4]:
                before, song, position, length, _ = last
                n = (at // 1000 - before // 1000 - 1) // self.every
                n = min(n, (length - position) // self.every) if length > 0 else n
                for k in range(1, n + 1):
                    yield Row(listener=key[0], ts=r["ts"] - timedelta(microseconds=at - before - k * self.every * 1000), kind="progress", song_id=song, position_ms=position + k * self.every, duration_ms=length)
            last = (at, r["song_id"], r["position_ms"], r["duration_ms"], r["playing"])
        if last is not None:
            self.state.update(tuple(last))

    def close(self) -> None:
        pass
