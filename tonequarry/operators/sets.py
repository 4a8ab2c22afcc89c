"""Playlists, favourites and queues as sets and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_all_folder(folders: DataFrame, songs: DataFrame, name: str = "All tracks") -> DataFrame:
    """(ordinal, folder, songs): a virtual folder of everything before the stored ones."""
    first = songs.agg(F.count(F.lit(1)).alias("songs")).select(F.lit(0).alias("ordinal"), F.lit(name).alias("folder"), "songs")
    return first.unionByName(folders.select(F.lit(1).alias("ordinal"), "folder", "songs"))


def appended(playlist: DataFrame, more: DataFrame) -> DataFrame:
    """playlist (name, position, song_id) and the songs of more (name, place, song_id) that it lacks, at its end in their order."""
    new = more.groupBy("name", "song_id").agg(F.min("place").alias("place")).join(playlist.select("name", "song_id"), ["name", "song_id"], "left_anti")
    ends = playlist.groupBy("name").agg((F.max("position") + 1).alias("end"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("place")) - 1
    placed = new.join(ends, "name", "left").select("name", (F.coalesce("end", F.lit(0)) + rank).cast("long").alias("position"), "song_id")
    return playlist.select("name", "position", "song_id").unionByName(placed)


def toggled(actions: DataFrame) -> DataFrame:
    """(song_id): members after a log of toggles and dislikes (song_id, at, kind): the parity of toggles since the last dislike, which also ends membership."""
    last = actions.where(F.col("kind") == "dislike").groupBy("song_id").agg(F.max("at").alias("since"))
    since = actions.where(F.col("kind") == "toggle").join(last, "song_id", "left").where(F.col("since").isNull() | (F.col("at") > F.col("since")))
    return since.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1).select("song_id")


def replaced(playlists: DataFrame, name: str, songs: DataFrame | None = None) -> DataFrame:
    """playlists with one overwritten by songs (position, song_id), or deleted."""
    rest = playlists.where(F.col("name") != name).select("name", "position", "song_id")
    return rest if songs is None else rest.unionByName(songs.select(F.lit(name).alias("name"), "position", "song_id"))


def without_virtual(playlists: DataFrame, virtual: str = "Favourites") -> DataFrame:
    return playlists.where(F.col("name") != virtual)


def removed_at(queue: Column, at: int) -> Column:
    return F.concat(F.slice(queue, 1, at), F.slice(queue, F.lit(at + 2), F.greatest(F.size(queue) - at - 1, F.lit(0))))


def inserted(queue: Column, at: Column | int, song: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    song = F.lit(song).cast("long") if isinstance(song, int) else song
    return F.concat(F.slice(queue, F.lit(1), at), F.array(song), F.slice(queue, at + 1, F.greatest(F.size(queue) - at, F.lit(0))))


def moved(queue: Column, source: int, target: int) -> Column:
    return inserted(removed_at(queue, source), target, F.element_at(queue, source + 1))


def after_current(queue: Column, current: Column | int, song: Column | int) -> Column:
    """The song right after the current one; at the front where that is not in the queue."""
    return inserted(queue, F.array_position(queue, current).cast("int"), song)


def ordered_join(ids: DataFrame, songs: DataFrame, column: str = "ids") -> DataFrame:
    """(position, song_id, ...) of a list of ids in its own order, without those that are gone."""
    return ids.select(F.posexplode(column).alias("position", "song_id")).join(songs, "song_id")
