"""The endless stream: a direction in vector space that finished and skipped tracks turn.

Scores are column expressions for one state against the whole library, and NumPy over the library's
matrix inside the state machine of the streaming processor; both follow the same constants.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.tables import DAY
from .history import taste_vector

PULL, PUSH, DISLIKE = 0.15, -0.10, -0.30
FINISHED, SKIPPED = 0.8, 0.3
AVOID, AVOID_HALF = 0.9, 2.0
DIRECTION, CONTINUITY, BONUS = 0.75, 0.25, 0.25
SHORTLIST, TEMPERATURE, COOLDOWN = 40, 0.12, 5
LEAST_DAYS, MORE_DAYS = 3.0, 57.0
AHEAD, MIN_LIBRARY, TTL_MS = 4, 40, 12 * 3_600_000
NOVELTY = 0.5


def hold_back(novelty: Column) -> Column:
    """Days for which a played track is held back."""
    return F.lit(LEAST_DAYS) + F.lit(MORE_DAYS) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), novelty))


def started(tracks: DataFrame, seed: DataFrame) -> DataFrame:
    """(centre, direction): the library's mean, and the unit vector from it to the seed."""
    centre = V.elementwise(tracks.select("vector"), "vector", [], F.avg, alias="centre")
    return centre.crossJoin(F.broadcast(seed.select(F.col("vector").alias("__seed")).limit(1))).select("centre", V.normalized(V.minus(F.col("__seed"), F.col("centre"))).alias("direction"))


def seed_vector(tracks: DataFrame, mode: str, current: int | None = None, text: DataFrame | None = None, weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(vector), one row or none: what a wave sets off from.

    'similar' takes the current track's vector, 'taste' the sum of liked vectors by weight, and both a random track
    where there is none; 'description' takes the encoded text, and nothing without one.
    """
    if mode == "description":
        return tracks.select(V.doubles(F.col("vector")).alias("vector")).limit(0) if text is None else text.select(V.doubles(F.col("vector")).alias("vector")).limit(1)
    wanted = tracks.where(F.col("song_id") == F.lit(current)) if mode == "similar" else taste_vector(weights, tracks)
    chance = tracks.orderBy(X.hash_uniform(seed, F.col("song_id")), "song_id").limit(1)
    rows = wanted.select(F.lit(0).alias("__turn"), V.doubles(F.col("vector")).alias("vector")).unionByName(chance.select(F.lit(1).alias("__turn"), V.doubles(F.col("vector")).alias("vector")))
    return rows.where(F.size("vector") > 0).orderBy("__turn").limit(1).select("vector")


def relaxed(candidates: DataFrame, now: int, novelty: float) -> DataFrame:
    """The candidates of the strictest level that has any.

    candidates: excluded, played, cooling (booleans), last_played. Level 0 allows neither cooling groups nor
    tracks held back, level 1 the former, level 2 both, level 3 even what was played; excluded never.
    """
    held = F.col("last_played").isNotNull() & (F.lit(now) - F.col("last_played") < hold_back(F.lit(novelty)) * DAY)
    level = F.when(F.col("played"), 3).when(held, 2).when(F.col("cooling"), 1).otherwise(0)
    rows = candidates.where(~F.col("excluded")).withColumn("level", level)
    least = rows.agg(F.min("level").alias("__least"))
    # A level admits all that stricter ones do; a strictest non-empty one is the least of any row.
    return rows.crossJoin(F.broadcast(least)).where(F.col("level") <= F.col("__least")).drop("__least")


def specific(centre: Column) -> Column:
    return V.normalized(V.minus(F.col("vector"), centre))


def scores(candidates: DataFrame, state: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """candidates with score. state is one row: centre, direction, avoid (or null), rejections, current (vector or null)."""
    cols = [F.col(c).alias(f"__{c}") for c in ("centre", "direction", "avoid", "rejections", "current")]
    rows = candidates.crossJoin(F.broadcast(state.select(*cols).limit(1))).withColumn("__own", specific(F.col("__centre")))
    towards = V.dot(F.col("__direction"), F.col("__own"))
    on = F.when(F.col("__current").isNull(), towards).otherwise(V.dot(V.normalized(V.minus(F.col("__current"), F.col("__centre"))), F.col("__own")))
    away = F.when(F.col("__avoid").isNull(), F.lit(0.0)).otherwise(AVOID * F.col("__rejections") / (F.col("__rejections") + AVOID_HALF) * V.dot(F.col("__avoid"), F.col("__own")))
    new = F.when(F.col("last_played").isNull(), F.lit(BONUS * novelty)).otherwise(F.lit(0.0))
    return rows.withColumn("score", DIRECTION * towards + CONTINUITY * on - away + new).drop("__own", *(f"__{c}" for c in ("centre", "direction", "avoid", "rejections", "current")))


def drawn(scored: DataFrame, seed: int, k: int = SHORTLIST) -> DataFrame:
    """One of the best k, by softmax: the largest of score over temperature plus Gumbel noise."""
    best = scored.orderBy(F.desc("score"), "song_id").limit(k)
    noise = -F.log(-F.log(X.hash_uniform(seed, F.col("song_id"))))
    return best.withColumn("draw", F.col("score") / TEMPERATURE + noise).orderBy(F.desc("draw"), "song_id").limit(1)


def windows_apart(picks: DataFrame, n: int = COOLDOWN) -> DataFrame:
    """picks with apart: whether the last n have n different groups."""
    w = Window.partitionBy("wave").orderBy("position").rowsBetween(-(n - 1), 0)
    return picks.withColumn("apart", F.size(F.collect_set("grp").over(w)) == F.count(F.lit(1)).over(w))


# The state machine. It holds no Spark objects, so that a stateful processor can run it.


@dataclass(frozen=True)
class Track:
    song_id: int
    vector: np.ndarray
    group: str
    last_played: int | None = None


@dataclass(frozen=True)
class State:
    direction: np.ndarray
    centre: np.ndarray
    avoid: np.ndarray | None = None
    played: frozenset[int] = frozenset()
    recent: tuple[str, ...] = ()
    steps: int = 0
    rejections: int = 0


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 else v


class Library:
    def __init__(self, tracks: list[Track]) -> None:
        self.tracks = tracks
        self.by_id = {t.song_id: k for k, t in enumerate(tracks)}
        self.x = np.stack([np.asarray(t.vector, dtype=float) for t in tracks]) if tracks else np.zeros((0, 1))
        self.centre = self.x.mean(0) if len(tracks) else np.zeros(1)
        self.ids = np.array([t.song_id for t in tracks], dtype=np.int64)
        self.last = np.array([np.nan if t.last_played is None else t.last_played for t in tracks], dtype=float)
        self.groups = {g: k for k, g in enumerate(dict.fromkeys(t.group for t in tracks))}
        self.group = np.array([self.groups[t.group] for t in tracks], dtype=np.int64)

    def among(self, songs) -> np.ndarray:
        """Which tracks are of these songs."""
        hit = np.zeros(len(self.ids), dtype=bool)
        hit[[self.by_id[k] for k in songs if k in self.by_id]] = True
        return hit

    def own(self, centre: np.ndarray) -> np.ndarray:
        d = self.x - centre
        n = np.sqrt((d * d).sum(1, keepdims=True))
        return np.where(n > 0, d / np.where(n > 0, n, 1), d)


def start(library: Library, seed: np.ndarray, playing: int | None = None) -> State:
    """A wave towards the seed; the group of the track that plays is cooling from the outset."""
    known = library.by_id.get(playing) if playing is not None else None
    return State(
        unit(np.asarray(seed, dtype=float) - library.centre),
        library.centre,
        played=frozenset() if known is None else frozenset({playing}),
        recent=() if known is None else (library.tracks[known].group,),
    )


def step_of(heard: float, disliked: bool = False) -> float:
    return DISLIKE if disliked else PULL if heard >= FINISHED else PUSH if heard < SKIPPED else 0.0


def react(state: State, track: Track, heard: float, disliked: bool = False) -> State:
    step = step_of(heard, disliked)
    own = unit(np.asarray(track.vector, dtype=float) - state.centre)
    direction, avoid, rejections = state.direction, state.avoid, state.rejections
    if step:
        direction = unit(direction + step * own)
    if step < 0:
        avoid = unit((np.zeros_like(own) if avoid is None else avoid) - step * own)
        rejections += 1
    return replace(state, direction=direction, avoid=avoid, rejections=rejections, played=state.played | {track.song_id}, recent=(*state.recent, track.group)[-COOLDOWN:], steps=state.steps + 1)


def uniform(seed: str, song_id: int) -> float:
    return (int(hashlib.md5(f"{seed}:{song_id}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def following(library: Library, state: State, now: int, seed: str, count: int = 1, excluded: frozenset[int] = frozenset(), current: int | None = None, novelty: float = NOVELTY) -> tuple[list[int], State]:
    """count picks and the state that knows them; each becomes the current track of the next."""
    own = library.own(state.centre)
    last, barred, played = library.last, library.among(excluded), library.among(state.played)
    held = (now - last) < (LEAST_DAYS + MORE_DAYS * min(1.0, max(0.0, novelty))) * DAY
    out: list[int] = []
    for k in range(count):
        cooling = np.isin(library.group, [library.groups[g] for g in state.recent if g in library.groups])
        level = np.select([barred, played, held, cooling], [9, 3, 2, 1], 0)
        least = level.min(initial=9)
        if least == 9:
            break
        pool = np.flatnonzero(level <= least)
        towards = own[pool] @ state.direction
        on = own[pool] @ own[library.by_id[current]] if current in library.by_id else towards
        score = DIRECTION * towards + CONTINUITY * on + np.where(np.isnan(last[pool]), BONUS * novelty, 0.0)
        if state.avoid is not None:
            score = score - AVOID * state.rejections / (state.rejections + AVOID_HALF) * (own[pool] @ state.avoid)
        best = np.lexsort((library.ids[pool], -score))[:SHORTLIST].tolist()
        draw = max(best, key=lambda j: score[j] / TEMPERATURE - np.log(-np.log(uniform(f"{seed}:{state.steps}:{k}", int(library.ids[pool[j]])))))
        track = library.tracks[pool[draw]]
        out.append(track.song_id)
        played[pool[draw]] = True
        state = replace(state, played=state.played | {track.song_id}, recent=(*state.recent, track.group)[-COOLDOWN:])
        current = track.song_id
    return out, state


_HEAD = struct.Struct("<BIIIiiq")
MOST_DIMENSIONS, MOST_ITEMS = 4096, 100_000


def encoded(state: State, mode: str, saved_at: int, description: str | None = None) -> bytes:
    """A session as bytes, vectors as 32-bit floats."""
    texts = [mode, *([] if description is None else [description]), *state.recent]
    raw = [t.encode() for t in texts]
    head = _HEAD.pack(1 | (2 if state.avoid is not None else 0) | (4 if description is not None else 0), len(state.direction), len(state.played), len(raw), state.steps, state.rejections, saved_at)
    vectors = [state.direction, state.centre, *([] if state.avoid is None else [state.avoid])]
    return head + b"".join(np.asarray(v, dtype="<f4").tobytes() for v in vectors) + np.asarray(sorted(state.played), dtype="<i8").tobytes() + b"".join(struct.pack("<I", len(t)) + t for t in raw)


def decoded(data: bytes) -> tuple[State, str, int, str | None] | None:
    """(state, mode, saved_at, description), or None if the bytes are not such a session."""
    try:
        flags, d, n, count, steps, rejections, saved_at = _HEAD.unpack_from(data)
        if not flags & 1 or not 1 <= d <= MOST_DIMENSIONS or n > MOST_ITEMS or count > MOST_ITEMS:
            return None
        at = _HEAD.size
        vectors = []
        for _ in range(3 if flags & 2 else 2):
            vectors.append(np.frombuffer(data, dtype="<f4", count=d, offset=at).astype(float))
            at += 4 * d
        played = frozenset(np.frombuffer(data, dtype="<i8", count=n, offset=at).tolist())
        at += 8 * n
        texts = []
        for _ in range(count):
            (size,) = struct.unpack_from("<I", data, at)
            if at + 4 + size > len(data):
                return None
            texts.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
        if at != len(data):
            return None
        mode, *rest = texts
        description = rest.pop(0) if flags & 4 else None
        return State(vectors[0], vectors[1], vectors[2] if flags & 2 else None, played, tuple(rest), steps, rejections), mode, saved_at, description
    except (struct.error, ValueError, UnicodeDecodeError):
        return None


SESSION = "mode string, description string, saved_at bigint, direction array<double>, centre array<double>, avoid array<double>, played array<bigint>, recent array<string>, steps int, rejections int"
MODES = ("similar", "description", "taste")


def stored(sessions: DataFrame, *keys: str) -> DataFrame:
    """(keys, session): sessions, with the columns of SESSION, as bytes. avoid and description may be null, recent holds groups."""
    names = [c.split()[0] for c in SESSION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for r in pa.Table.from_batches([batch]).select(names).to_pylist():
                vector = lambda v: None if v is None else np.asarray(v, dtype=float)
                state = State(vector(r["direction"]), vector(r["centre"]), vector(r["avoid"]), frozenset(r["played"]), tuple(r["recent"]), r["steps"], r["rejections"])
                raw.append(encoded(state, r["mode"], r["saved_at"], r["description"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(raw, pa.binary())], [*keys, "session"])

    kinds = "".join(f"`{c}` {sessions.schema[c].dataType.simpleString()}, " for c in keys)
    return sessions.select(*keys, *names).mapInArrow(run, f"{kinds}session binary")


def restored(rows: DataFrame, *keys: str) -> DataFrame:
    """rows' keys with the columns of SESSION of each row's bytes; null and damaged ones are left out."""
    names = [c.split()[0] for c in SESSION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for k, data in enumerate(batch.column(len(keys)).to_pylist()):
                found = None if data is None else decoded(data)
                if found:
                    state, mode, saved_at, description = found
                    kept.append(k)
                    out.append((mode, description, saved_at, state.direction.tolist(), state.centre.tolist(), None if state.avoid is None else state.avoid.tolist(), sorted(state.played), list(state.recent), state.steps, state.rejections))
            own = [batch.column(k).take(pa.array(kept, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(_ARROW))], [*keys, *names])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return rows.select(*keys, "session").mapInArrow(run, f"{kinds}{SESSION}")


_DOUBLES = pa.list_(pa.float64())
_ARROW = (pa.string(), pa.string(), pa.int64(), _DOUBLES, _DOUBLES, _DOUBLES, pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.int32())


def can_resume(playing: Column, now: Column | int) -> Column:
    """resumes() of rows with the columns of SESSION."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.coalesce(F.col("mode").isin(*MODES) & F.array_contains("played", playing) & (now - F.col("saved_at") <= TTL_MS), F.lit(False))


def resumes(mode: str, state: State, saved_at: int, playing: int, now: int, modes: frozenset[str] = frozenset(MODES)) -> bool:
    return mode in modes and playing in state.played and now - saved_at <= TTL_MS
