"""Albums out of clusters: centroids, names by label vectors, titles, signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

BASELINE, MIN_SONGS, LEADING = 0.5, 8, 3


def centroids(clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """(cluster, vector): the unit sum of the members' vectors."""
    members = clusters.where(F.col("cluster") >= 0).join(tracks.select("song_id", "vector"), "song_id")
    return V.elementwise(members, "vector", ["cluster"], F.sum).select("cluster", V.normalized(F.col("vector")).alias("vector"))


def named(albums: DataFrame, labels: DataFrame, whole: DataFrame) -> DataFrame:
    """(cluster, label_idx, score): the label that suits an album beyond what it suits the library; ties go to the lower index.

    labels is a fixed vocabulary of tens of rows, broadcast.
    """
    base = whole.select(F.col("vector").alias("__library")).limit(1)
    known = labels.crossJoin(F.broadcast(base)).select("label_idx", F.col("vector").alias("__label"), (BASELINE * V.dot(F.col("vector"), F.col("__library"))).alias("__base"))
    pairs = albums.crossJoin(F.broadcast(known)).withColumn("score", V.dot(F.col("vector"), F.col("__label")) - F.col("__base"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "label_idx")
    return pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select("cluster", "label_idx", "score")


def leading_artists(members: DataFrame, k: int = LEADING) -> DataFrame:
    """(cluster, subtitle): the most frequent artists, first seen first among equals. members: cluster, artist (or null), place."""
    by = members.where(F.col("artist").isNotNull()).groupBy("cluster", "artist").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "first")
    top = by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "artist"))), lambda s: s["artist"])
    return top.groupBy("cluster").agg(F.array_join(names, ", ").alias("subtitle"))


def dominant_artist(members: DataFrame) -> DataFrame:
    """(cluster, artist): the artist of half the album's tracks or more, unresolved ones counting as others."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    by = members.where(F.col("artist").isNotNull()).groupBy("cluster", "artist").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "first")
    top = by.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return top.join(sizes, "cluster").where(2 * F.col("n") >= F.col("size")).select("cluster", "artist")


def titles(rows: pd.DataFrame) -> list[str]:
    """Titles without repeats for albums in order of size: plain, with the artist, or numbered from 2. rows: title, artist (or None)."""
    used: set[str] = set()
    out = []
    for title, artist in zip(rows["title"], rows["artist"], strict=True):
        name = title
        if name in used and isinstance(artist, str) and artist and f"{title} · {artist}" not in used:
            name = f"{title} · {artist}"
        n = 2
        while name in used:
            name = f"{title} {n}"
            n += 1
        used.add(name)
        out.append(name)
    return out


def titled(albums: DataFrame) -> DataFrame:
    """(library, cluster, title) per library, which has some hundred albums at most: each takes 8 tracks. albums: library, cluster, size, title, artist."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "cluster"], ascending=[False, True])
        return pd.DataFrame({"library": rows["library"], "cluster": rows["cluster"], "title": titles(rows)})

    return albums.groupBy("library").applyInPandas(run, "library bigint, cluster bigint, title string")


def untitled(albums: DataFrame) -> DataFrame:
    """(library, cluster, title) where there are no labels to name albums by: Mix 1, Mix 2 and so on, the largest first. albums: library, cluster, size."""
    w = Window.partitionBy("library").orderBy(F.desc("size"), "cluster")
    return albums.select("library", "cluster", F.concat(F.lit("Mix "), F.row_number().over(w).cast("string")).alias("title"))


def by_size(clusters: DataFrame) -> DataFrame:
    """(cluster, size, place): the largest first, then the one with the smallest song. clusters: song_id, cluster; the window is over a row per cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("song_id").alias("first"))
    return sizes.select("cluster", "size", F.row_number().over(Window.orderBy(F.desc("size"), "first")).alias("place"))


def set_id(ids: Column) -> Column:
    """A hash of a set of ids, in whatever order they come."""
    return F.sha2(F.array_join(F.array_sort(ids).cast("array<string>"), ",").cast("binary"), 256)


def signature(ids: Column, variant: str, vocabulary: str, scale: float) -> Column:
    """What an album build depends on: the library's ids, the model's variant, the vocabulary and the user's scale."""
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(ids).cast("array<string>"), ","), F.lit(variant), F.lit(vocabulary), F.lit(f"{scale:.2f}"), F.size(ids).cast("string")).cast("binary"), 256)
