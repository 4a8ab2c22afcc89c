import datetime as dt
import os
import time
import wave

import numpy as np
import pytest

from tonequarry.operators import wave as W
from tonequarry.sources.tables import PLAYER_EVENTS
from tonequarry.streaming import listens as L
from tonequarry.streaming import player as P
from tonequarry.streaming import scan as Sc
from tonequarry.streaming import wave as SW


def test_tracker():
    t = L.Tracker()
    assert t.on("finished", None, 5, 0) is None and t.on("progress", None, 5, 0) is None
    assert t.on("started", 1, 0, 100_000) is None
    assert t.on("progress", 1, 50_000, 0) is None and t.on("progress", 1, 20_000, 0) is None
    assert t.on("finished", 1, 0, 0) == (1, 50_000, 100_000)
    assert t.on("finished", 1, 0, 0) is None
    t.on("started", 2, 0, 100)
    t.on("progress", 2, 90, 0)
    assert t.on("started", 3, 0, 100) == (2, 90, 100)


def events(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    rows = [
        (1, at(0), "started", 10, 0, 100_000), (1, at(5), "progress", 10, 90_000, 100_000), (1, at(9), "started", 11, 0, 60_000),
        (1, at(20), "finished", 11, 1_000, 60_000), (2, at(1), "progress", 5, 7, 0), (2, at(2), "started", 5, 0, 0), (2, at(9), "progress", 5, 4_000, 8_000),
        (2, at(30), "finished", 5, 8_000, 8_000),
    ]
    return spark.createDataFrame(rows, PLAYER_EVENTS)


EXPECTED = {(1, 10, 90_000, 100_000), (1, 11, 1_000, 60_000), (2, 5, 8_000, 8_000)}


def test_stream_and_batch_twin(spark, tmp_path):
    rows = events(spark)
    take = lambda df: {tuple(r) for r in df.select("listener", "song_id", "played_ms", "duration_ms").collect()}
    assert take(L.departures(rows)) == EXPECTED
    L.use_rocksdb(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = L.track_listens(L.player_events(spark, str(tmp_path / "in")))
    steered = []
    q = L.fan_out(stream, lambda b: steered.append({tuple(r)[:1] + tuple(r)[2:] for r in b.collect()}), str(tmp_path / "history"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert set().union(*steered) == EXPECTED
    assert take(spark.read.parquet(str(tmp_path / "history"))) == {e for e in EXPECTED if e[2] >= 3000}


def test_wave_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (60, 8))
    lib = W.Library([W.Track(k, v / np.linalg.norm(v), f"g{k % 20}") for k, v in enumerate(x)])
    L.use_rocksdb(spark)
    schema = "listener long, ts long, kind string, song_id long, played_ms long, duration_ms long"
    spark.createDataFrame([(1, 1000, "start", 5, 0, 0), (1, 2000, "departed", 5, 1_000, 100_000), (1, 2500, "departed", 999, 1, 1), (2, 3000, "departed", 3, 1, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    # Listener 4 goes on to the first pick: one more is needed to keep the queue full, and nothing is replaced.
    first = W.following(lib, W.start(lib, lib.tracks[5].vector, 5), 1000, "wave:4", W.AHEAD, frozenset(), 5, W.NOVELTY)[0][0]
    moves = [(4, 1000, "start", 5, 0, 0), (4, 2000, "changed", first, 0, 0), (3, 2000, "changed", 7, 0, 0)]
    spark.createDataFrame(moves, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    picks = SW.steered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lib)
    # A stateful query with a time to live looks at its timers again and again, so it is stopped, not awaited.
    q = picks.writeStream.format("memory").queryName("picks").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and q.exception() is None and spark.table("picks").count() < 13:
            time.sleep(1)
        assert q.exception() is None
        got = spark.table("picks").toPandas()
    finally:
        q.stop()
    assert set(got["kind"]) == {"pick"}
    moved = got[got["listener"] == 4]
    assert len(moved) == 5 and moved["replaces"].sum() == 4 and moved["song_id"].is_unique and sorted(moved["position"]) == [0, 1, 2, 3, 3]
    got = got[got["listener"] != 4]
    assert set(got["listener"]) == {1} and len(got) == 8 and got["replaces"].all() and got["song_id"].is_unique and 5 not in set(got["song_id"])


def test_sessions(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0), 5), (1, at(20), 5), (1, at(90), 5)], "listener long, ts timestamp, played_ms long")
    assert sorted(r["listens"] for r in L.sessions(df).collect()) == [1, 2]


def test_pace_of_streams(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    schema = "listener long, ts timestamp, text string"
    rows = spark.createDataFrame([(1, at(0), "a"), (1, at(200), "ab"), (1, at(450), "abc"), (1, at(900), "x"), (2, at(100), "q")], schema)
    take = lambda df: sorted(r["text"] for r in df.collect())
    assert take(P.debounced(rows, ["listener"], ["text"])) == ["abc", "q", "x"]
    assert take(P.throttled(rows, ["listener"], ["text"])) == ["ab", "abc", "q", "x"]
    assert [r["day"] for r in P.days_begun(rows, ["listener"]).collect()] == ["2024-01-01"] * 2
    assert take(P.debounced(rows.limit(0), ["listener"], ["text"])) == []
    # The same rows as a stream; a far later one lets the windows close.
    rows.unionByName(spark.createDataFrame([(9, at(60_000), "z")], schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = P.debounced(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["listener"], ["text"])
    q = stream.writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert take(spark.table("settled")) == ["abc", "q", "x"]


def test_live_folders(spark, tmp_path):
    songs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "song_id long, folder string")
    spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "song_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = P.analysed_by_folder(spark.readStream.schema("song_id long").parquet(str(tmp_path / "in")), songs)
    q = live.writeStream.format("memory").outputMode("update").queryName("folders").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("folders").collect()} == {("a", 2), ("b", 1)}


def test_callbacks(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    rows = [
        (1, at(0), "transition", 5, None, None), (1, at(1), "ready", 5, 0, 9_000), (1, at(2), "ended", 5, 1, 9_000), (1, at(3), "transition", 6, 0, -1),
        (1, at(4), "jump", 6, 4_000, -5), (1, at(5), "transition", None, 0, 0), (1, at(6), "transition", 7, 0, 8_000), (1, at(7), "closed", 7, 3_000, 8_000),
        (1, at(8), "volume", 7, 1, 1), (2, None, "pause", None, None, None),
    ]
    told = P.normalised(spark.createDataFrame(rows, "listener long, ts timestamp, callback string, song_id long, position_ms long, duration_ms long"))
    assert told.columns == PLAYER_EVENTS.names
    left = L.departures(told).select("song_id", "played_ms", "duration_ms").collect()
    assert {tuple(r) for r in left} == {(5, 9_000, 9_000), (6, 4_000, 0), (7, 3_000, 8_000)}


def tone(path, pitch, seconds=0.3):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(48_000)
        f.writeframes((8000 * np.sin(2 * np.pi * pitch * np.arange(int(48_000 * seconds)) / 48_000)).astype("<i2").tobytes())


def test_scan_stops_resumes_and_replaces(spark, tmp_path):
    media = tmp_path / "media"
    media.mkdir()
    for k in range(7):
        tone(media / f"{k}.wav", 200 + 100 * k)
        os.utime(media / f"{k}.wav", (1000 + k, 1000 + k))
    (media / "7.wav").write_bytes(b"no sound")
    os.utime(media / "7.wav", (1007, 1007))
    tone(media / "99.wav", 50)  # not in the library
    os.utime(media / "99.wav", (999, 999))
    library = spark.createDataFrame([(k, f"file://{media}/{k}.wav") for k in range(8)], "song_id long, path string")
    store = Sc.vector_store(str(tmp_path / "store"))
    parts = lambda b: sorted(p.name for p in (tmp_path / "store").glob(f"stream=*/batch={b}/*.parquet"))

    def dies(number):
        if number == 1:
            raise RuntimeError("stopped in the middle")

    progress = Sc.Progress(9)
    spark.streams.addListener(progress)
    try:
        with pytest.raises(Exception, match="stopped in the middle"):
            Sc.scan(str(media), library, store, str(tmp_path / "cp"), per_batch=3, then=dies).awaitTermination()
        # Batch 1 was stored, but its stream did not get to say so.
        first, second = parts(0), parts(1)
        assert first and second and store.count(spark) == 5
        Sc.scan(str(media), library, store, str(tmp_path / "cp"), per_batch=3).awaitTermination()
        until = time.time() + 30
        while time.time() < until and progress.ended < 2:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert parts(0) == first and parts(1) != second and len(parts(2)) > 0
    rows = {r["song_id"]: r for r in store.latest(spark).collect()}
    assert sorted(rows) == list(range(8)) and spark.read.parquet(str(tmp_path / "store")).count() == 8
    assert not any(rows[7]["vector"]) and all(any(rows[k]["vector"]) for k in range(7))
    assert progress.done == 9 and progress.batches == 3 and progress.pace > 0 and progress.left == 0
    # Another scan of the same folder finds nothing to do but the file that has changed since.
    tone(media / "2.wav", 5000)
    os.utime(media / "2.wav", (5000, 5000))
    Sc.scan(str(media), library, store, str(tmp_path / "cp2")).awaitTermination()
    after = {r["song_id"]: r for r in store.latest(spark).collect()}
    assert after[2]["vector"] != rows[2]["vector"] and {k for k in rows if after[k] != rows[k]} == {2}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 9
    # A newer analysis takes all again.
    Sc.scan(str(media), library, store, str(tmp_path / "cp3"), version=3).awaitTermination()
    assert {r["version"] for r in store.latest(spark).collect()} == {3}
    store.clear(spark)
    assert store.count(spark) == 0


def test_upserts_keep_the_newest(spark, tmp_path):
    schema = "k long, at long, text string"
    for k, rows in enumerate([[(1, 5, "b"), (1, 3, "a"), (2, 1, "x")], [(1, 4, "late"), (2, 2, "y"), (2, 2, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = Sc.Store(str(tmp_path / "store"), schema, ["k"], ["at"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        Sc.upserts(stream, store, str(tmp_path / "cp")).awaitTermination()
        assert sorted(map(tuple, store.latest(spark).collect())) == [[(1, 5, "b"), (2, 1, "x")], [(1, 5, "b"), (2, 2, "z")]][k]


def files_in_turn(spark, path, schema, batches):
    """A stream that takes each batch's rows as a file of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_days_as_a_stream(spark, tmp_path):
    L.use_rocksdb(spark)
    at = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    batches = [
        [(1, "a", at(1, 9)), (1, "a", at(1, 8)), (2, "a", at(1, 23, 50))],
        [(1, "a", at(1, 23, 59)), (2, "a", at(2, 0, 0))],
        [(1, "a", at(2, 0, 5)), (2, "a", at(1, 23, 55))],  # a late row of a day that has begun already
        [(1, "a", at(3, 7)), (1, "b", at(3, 7, 30))],
        [(2, "a", at(1, 22)), (1, "a", at(3, 8))],  # its day is over for good
        [(9, "z", at(5, 0))],
    ]
    stream = P.days_begun(files_in_turn(spark, str(tmp_path / "in"), "listener long, device string, ts timestamp", batches), ["listener", "device"])
    q = stream.writeStream.format("memory").outputMode("append").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["listener"], r["device"], r["day"], r["ts"]) for r in spark.table("days").collect())
    assert got == [
        (1, "a", "2024-03-01", at(1, 8)), (1, "a", "2024-03-02", at(2, 0, 5)), (1, "a", "2024-03-03", at(3, 7)), (1, "b", "2024-03-03", at(3, 7, 30)),
        (2, "a", "2024-03-01", at(1, 23, 50)), (2, "a", "2024-03-02", at(2, 0, 0)), (9, "z", "2024-03-05", at(5, 0)),
    ]
    # All days but the last have been forgotten.
    held = spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "cp")).collect()
    assert len(held) == 1


def library(n=60):
    x = np.random.default_rng(0).normal(0, 1, (n, 8))
    return W.Library([W.Track(k, v / np.linalg.norm(v), f"g{k % 20}") for k, v in enumerate(x)])


class Held:
    """A processor's state in memory."""

    def __init__(self):
        self.value, self.rows = None, {}

    def getValueState(self, *a, **k):  # noqa: N802
        return self

    def getMapState(self, *a, **k):  # noqa: N802
        held = Held()
        held.iterator, held.updateValue = (lambda: iter(held.rows.items())), held.rows.__setitem__
        return held

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def event(ts, kind, song, played=0, length=100_000):
    return dict(listener=1, ts=ts, kind=kind, song_id=song, played_ms=played, duration_ms=length)


def turned(batches, first=None):
    p, held = SW.WaveProcessor(library()), Held()
    p.init(held)
    if first is not None:
        p.handleInitialState((1,), {"session": first}, None)
    out = [list(p.handleInputRows((1,), rows, None)) for rows in batches]
    return out, None if held.value is None else W.decoded(bytes(held.value[0]))[0], p


def test_a_dislike_counts_once_across_batches():
    rows = [event(1000, "start", 5), event(2000, "dislike", 5), event(2500, "departed", 5, 1_000)]
    together, one, _ = turned([rows])
    apart, other, p = turned([[r] for r in rows])
    assert one.steps == other.steps == 1 and one.rejections == other.rejections == 1 and np.allclose(one.direction, other.direction)
    for got in (sum(together, []), sum(apart, [])):
        undone = [r for r in got if r["kind"] == "unfavourite"]
        assert [(r["song_id"], r["position"]) for r in undone] == [(5, None)]
    # Played again and left again, it counts; it is never picked.
    later = list(p.handleInputRows((1,), [event(9000, "departed", 5, 90_000)], None))
    assert W.decoded(bytes(p.state.get()[0]))[0].steps == 2 and 5 not in {r["song_id"] for r in later}
    # Outside a wave, or of a song that the library lacks, only the favourite is undone.
    alone, state, _ = turned([[event(1, "dislike", 7), event(2, "dislike", 999)]])
    assert [(r["kind"], r["song_id"]) for r in alone[0]] == [("unfavourite", 7), ("unfavourite", 999)] and state is None
    after, _, _ = turned([[event(1, "dislike", 7)], *[[event(10 + k, "start", k)] for k in range(6)]])
    assert 7 not in {r["song_id"] for batch in after for r in batch if r["kind"] == "pick"}


HOUR = 3_600_000


@pytest.mark.parametrize("hours, song, goes_on", [(11, 5, True), (13, 5, False), (1, 6, False)])
def test_sessions_resume(hours, song, goes_on):
    lib = library()
    left = W.react(W.start(lib, lib.tracks[5].vector, 5), lib.tracks[5], 1.0)
    out, state, _ = turned([[event(hours * HOUR, "changed", song)]], W.encoded(left, "taste", 0, None))
    assert (state is not None) == goes_on and (len(out[0]) == W.AHEAD) == goes_on
    if goes_on:
        assert state.steps == 1 and np.allclose(state.direction, left.direction, atol=1e-6)
    assert turned([[event(1, "changed", 5)]], b"damaged")[1] is None


def test_wave_stream_from_stored_sessions(spark, tmp_path):
    lib = library()
    L.use_rocksdb(spark)
    left = W.encoded(W.react(W.start(lib, lib.tracks[5].vector, 5), lib.tracks[5], 1.0), "similar", 0)
    sessions = spark.createDataFrame([(1, bytearray(left)), (2, bytearray(left)), (3, bytearray(left))], "listener long, session binary")
    schema = "listener long, ts long, kind string, song_id long, played_ms long, duration_ms long"
    batches = [[(1, 11 * HOUR, "changed", 5, 0, 0), (2, 13 * HOUR, "changed", 5, 0, 0)], [(1, 11 * HOUR + 1, "dislike", 5, 0, 0)], [(1, 11 * HOUR + 2, "departed", 5, 1_000, 100_000), (3, 1, "changed", 5, 0, 0)]]
    picks = SW.steered(files_in_turn(spark, str(tmp_path / "in"), schema, batches), lib, sessions=sessions)
    q = picks.writeStream.format("memory").queryName("resumed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and q.exception() is None and spark.table("resumed").where("listener = 3").count() < W.AHEAD:
            time.sleep(1)
        assert q.exception() is None
        got = spark.table("resumed").toPandas()
    finally:
        q.stop()
    # The first fill, the fill after the dislike, and nothing for the departure of the same play.
    assert got[got["kind"] == "pick"].groupby("listener").size().to_dict() == {1: 2 * W.AHEAD, 3: W.AHEAD}
    assert got[got["kind"] == "unfavourite"][["listener", "song_id"]].values.tolist() == [[1, 5]]


def test_a_library_too_large_is_refused(monkeypatch):
    monkeypatch.setattr(SW, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        SW.steered(None, library())


STATES = "listener long, ts timestamp, song_id long, position_ms long, duration_ms long, playing boolean"


def states():
    at = lambda ms: dt.datetime(2024, 1, 1, 12, 0, 0) + dt.timedelta(milliseconds=ms)
    return [
        [(1, at(0), 10, 0, 3_000, True), (1, at(1_700), 10, 1_700, 3_000, False), (2, at(0), 20, 2_000, 2_600, True)],
        [(1, at(5_000), 10, 1_700, 3_000, True), (1, at(6_000), 11, 0, None, True), (2, at(9_000), 21, None, 0, True)],
        [(1, at(7_501), 11, 1_501, None, False), (2, at(9_400), 21, 400, 0, False), (3, at(0), 30, 0, 0, True)],
    ]


#: (listener, song, ms since noon, position): the end of a track and the next state end the samples, which never lie upon that state.
SAMPLES = {
    (1, 10, 500, 500), (1, 10, 1_000, 1_000), (1, 10, 1_500, 1_500), (2, 20, 500, 2_500), (1, 10, 5_500, 2_200),
    (1, 11, 6_500, 500), (1, 11, 7_000, 1_000), (1, 11, 7_500, 1_500),
}


def samples_of(rows):
    noon = dt.datetime(2024, 1, 1, 12, 0, 0)
    return sorted((r["listener"], r["song_id"], round((r["ts"] - noon).total_seconds() * 1000), r["position_ms"]) for r in rows)


def test_positions_are_sampled(spark):
    got = P.sampled(spark.createDataFrame([r for b in states() for r in b], STATES)).collect()
    assert samples_of(got) == sorted(SAMPLES) and {r["kind"] for r in got} == {"progress"}
    assert P.sampled(spark.createDataFrame([], STATES)).count() == 0


def test_positions_are_sampled_in_a_stream(spark, tmp_path):
    L.use_rocksdb(spark)
    late = [(1, dt.datetime(2024, 1, 1, 12, 0, 1), 10, 0, 0, True)]
    found = P.sampled(files_in_turn(spark, str(tmp_path / "in"), STATES, [*states(), late]))
    q = found.writeStream.format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert samples_of(spark.table("positions").collect()) == sorted(SAMPLES)
