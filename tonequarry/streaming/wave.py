"""The wave as a stream: each listener's state turns with every departure, and picks are emitted to keep the queue full."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import wave as W

#: kind: pick, or unfavourite, which says that a disliked song is a favourite no more; position and replaces are null then.
PICK = "listener bigint, kind string, step int, position int, song_id bigint, replaces boolean"
_STATE = T.StructType([T.StructField("session", T.BinaryType()), T.StructField("queue", T.ArrayType(T.LongType())), T.StructField("restored", T.BooleanType())])
_SONG, _PENDING = T.StructType([T.StructField("song_id", T.LongType())]), T.StructType([T.StructField("pending", T.BooleanType())])
#: Bytes of a library's vectors that a processor takes along, at most.
MOST_BYTES = 256 << 20


def heard(played: int, duration: int) -> float:
    return min(1.0, max(0.0, played / duration)) if duration > 0 else 0.0


class WaveProcessor(StatefulProcessor):
    """Events: listener, ts (ms), kind (start, departed, dislike, changed), song_id, played_ms, duration_ms.

    A start seeds the wave with its song. A departure of a song that the wave never played is ignored; a
    dislike and the departure of the same play react once, by the dislike, in whichever batches they come. Fewer than
    AHEAD songs ahead are filled up; a skip or a dislike replaces them all. A change of track, to whichever song, only
    fills up. A session ends after its time to live. A disliked song is picked no more, and its row of kind
    unfavourite comes out, also outside a wave.

    A stored session is taken up again if the first song heard is one that it played and it is not too old; else it goes.
    """

    def __init__(self, library: W.Library, seed: str = "wave", novelty: float = W.NOVELTY) -> None:
        self.library, self.seed, self.novelty = library, seed, novelty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("wave", _STATE, ttlDurationMs=W.TTL_MS)
        self.dislikes = handle.getMapState("dislikes", _SONG, _PENDING)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        if initialState["session"] is not None and W.decoded(bytes(initialState["session"])):
            self.state.update((bytes(initialState["session"]), [], True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        library = self.library
        state, queue, mode, saved_at, restored, told = None, [], "similar", 0, False, None
        if self.state.exists():
            session, queue, restored = self.state.get()
            found = W.decoded(bytes(session))
            if found:
                state, mode, saved_at, told = found
            queue = list(queue) if found else []
        disliked = {k[0]: v[0] for k, v in self.dislikes.iterator()}
        at = 0
        for r in sorted(rows, key=lambda r: (r["ts"], r["kind"] != "dislike")):
            song, at = r["song_id"], r["ts"]
            if r["kind"] == "dislike" and song is not None:
                # Until the play that it was told of departs.
                disliked[song] = True
                self.dislikes.updateValue((song,), (True,))
                yield Row(listener=key[0], kind="unfavourite", step=0 if state is None else state.steps, position=None, song_id=song, replaces=None)
            if song not in library.by_id:
                continue
            track = library.tracks[library.by_id[song]]
            replaces = False
            if restored and r["kind"] != "start" and not W.resumes(mode, state, saved_at, song, at):
                state, queue = None, []
            restored = False
            if r["kind"] == "start":
                state, queue, replaces, mode, told = W.start(library, track.vector, song), [], True, "similar", None
            elif state is None or (song not in state.played and r["kind"] != "changed"):
                continue
            elif r["kind"] == "changed":
                pass
            elif r["kind"] == "dislike":
                state, replaces = W.react(state, track, 0.0, True), True
            elif disliked.get(song):
                disliked[song] = False
                self.dislikes.updateValue((song,), (False,))
            else:
                part = heard(r["played_ms"] or 0, r["duration_ms"] or 0)
                state, replaces = W.react(state, track, part), part < W.SKIPPED
            queue = [] if replaces else [q for q in queue if q != song]
            if len(queue) < W.AHEAD:
                picks, state = W.following(library, state, at, f"{self.seed}:{key[0]}", W.AHEAD - len(queue), frozenset(disliked), song, self.novelty)
                for k, p in enumerate(picks):
                    yield Row(listener=key[0], kind="pick", step=state.steps, position=len(queue) + k, song_id=p, replaces=replaces)
                queue += picks
        if state is not None and not restored:
            self.state.update((W.encoded(state, mode, at, told), queue, False))
        elif state is None:
            self.state.clear()

    def close(self) -> None:
        pass


def steered(events: DataFrame, library: W.Library, seed: str = "wave", novelty: float = W.NOVELTY, sessions: DataFrame | None = None) -> DataFrame:
    """Picks of a stream of events, and what dislikes undo; sessions (listener, session) are stored ones to go on from.

    The library, some ten thousand vectors, travels with the processor, as broadcasts don't reach its first run; one over
    MOST_BYTES is refused.
    """
    if library.x.nbytes > MOST_BYTES:
        raise ValueError(f"a library of {library.x.nbytes >> 20} MB is too large for a processor")
    first = None if sessions is None else sessions.select("listener", "session").groupBy("listener")
    return events.groupBy("listener").transformWithState(WaveProcessor(library, seed, novelty), PICK, "Append", "ProcessingTime", first)
