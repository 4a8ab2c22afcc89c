"""Listens: recording, windows of time, retention, and the taste that they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import DAY, KEEP_DAYS, MIN_LISTEN_MS, PROFILE_DAYS, fraction

FINISHED, SKIPPED = 0.8, 0.3
FAVOURITE, HALF_LIFE_DAYS = 2.0, 21.0


def recorded(departures: DataFrame) -> DataFrame:
    """Departures long enough to be listens."""
    return departures.where(F.col("played_ms") >= MIN_LISTEN_MS)


def listens_since(listens: DataFrame, now: int, days: int = PROFILE_DAYS) -> DataFrame:
    return listens.where(F.col("played_at") >= now - days * DAY)


def pruned(listens: DataFrame, now: int, days: int = KEEP_DAYS) -> DataFrame:
    """What retention leaves."""
    return listens.where(F.col("played_at") >= now - days * DAY)


def last_played(listens: DataFrame, *keys: str) -> DataFrame:
    return listens.groupBy(*keys, "song_id").agg(F.max("played_at").alias("last_played"))


def taste_of(heard: Column) -> Column:
    """What one listen says: finished, part of it, or skipped."""
    return F.when(heard >= FINISHED, F.lit(1.0)).when(heard >= SKIPPED, F.lit(0.3)).otherwise(F.lit(-0.7))


def steer_of(heard: Column, disliked: Column) -> Column:
    """What a listen does to a wave: a step towards the track, or away from it."""
    return F.when(disliked, F.lit(-0.30)).when(heard >= FINISHED, F.lit(0.15)).when(heard < SKIPPED, F.lit(-0.10)).otherwise(F.lit(0.0))


def decay(played_at: Column, now: int) -> Column:
    age = F.greatest(F.lit(0).cast("long"), F.lit(now) - played_at) / F.lit(float(DAY))
    return F.exp(-F.log(F.lit(2.0)) * age / HALF_LIFE_DAYS)


def taste_weights(listens: DataFrame, favourites: DataFrame | None, now: int, *keys: str) -> DataFrame:
    """(keys, song_id, weight): decayed listens, and the favourites' share whether heard or not.

    With keys, favourites must have them too.
    """
    base = listens.select(*keys, "song_id", (taste_of(fraction(F.col("played_ms"), F.col("duration_ms"))) * decay(F.col("played_at"), now)).alias("weight"))
    if favourites is not None:
        base = base.unionByName(favourites.select(*keys, "song_id", F.lit(FAVOURITE).alias("weight")))
    return base.groupBy(*keys, "song_id").agg(F.sum("weight").alias("weight"))


def taste_vector(weights: DataFrame, tracks: DataFrame, *keys: str) -> DataFrame:
    """The sum of liked vectors by weight, not normalised."""
    liked = weights.where(F.col("weight") > 0).join(tracks.select("song_id", "vector"), "song_id")
    return V.elementwise(liked, "vector", list(keys), F.sum, "weight")
