"""Tables of the domain: schemas, the views over the fixed test tables, and the readers that clean what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000
#: The clock of the queries: events end the day before. Queries never read the wall clock.
NOW = 1_706_659_200_000
MIN_LISTEN_MS = 3_000
PROFILE_DAYS, KEEP_DAYS = 90, 365
ANALYSIS_VERSION = 2

SONGS = T.StructType(
    [
        T.StructField("song_id", T.LongType(), False),
        *(T.StructField(n, T.StringType()) for n in ("title", "artist", "album")),
        T.StructField("album_id", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("uri", "path", "folder_name")),
    ]
)
EMBEDDINGS = T.StructType([T.StructField("song_id", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False))])
PLAY_EVENTS = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "song_id", "played_at", "played_ms", "duration_ms")])
PLAYER_EVENTS = T.StructType(
    [
        T.StructField("listener", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("song_id", T.LongType()),
        T.StructField("position_ms", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)
DAILY_DOCUMENT = "struct<day:string,attempt:int,ids:array<bigint>,recent:array<struct<day:string,ids:array<bigint>>>>"
PREFERENCES = "struct<favourites:array<bigint>,dislikes:array<bigint>,queue:array<bigint>,playlists:array<struct<name:string,ids:array<bigint>>>>"
ALBUMS_DOCUMENT = "struct<signature:string,named:boolean,albums:array<struct<label:int,songIds:array<bigint>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, vector, label); rows without a vector are skipped."""
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("song_id"), F.col("embedding").alias("vector"), "label")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media library as scanned, with nulls where a track has no tags; a third of the artists are in the title only."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("song_id"))
    untagged = F.col("song_id") % 3 == 0
    return ids.join(part, F.col("song_id") == F.col("p_partkey"), "left").select(
        "song_id",
        F.when(untagged, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.col("p_name")).alias("title"),
        F.when(untagged & F.col("p_brand").isNotNull(), F.lit("<unknown>")).otherwise(F.col("p_brand")).alias("artist"),
        F.concat(F.lit("/music/"), "p_type", F.lit("/"), F.col("song_id").cast("string"), F.lit(".mp3")).alias("path"),
        F.coalesce(F.col("p_size") > 0, F.lit(True)).alias("is_music"),
    )


def cleaned(raw: DataFrame) -> DataFrame:
    """Songs of a raw library: music only, missing tags named, folder from the path."""
    unknown = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    folder = F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]+)/[^/]+$", 1)
    return raw.where("is_music").select("song_id", unknown("title"), unknown("artist"), F.coalesce("path", F.lit("")).alias("path"), F.when(folder == "", "Unknown").otherwise(folder).alias("folder"))


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned library without its order, which a join would only throw away."""
    return cleaned(library(spark, sf_dir))


def play_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, listener, song_id, played_at, played_ms, duration_ms), all departures however short."""
    return plays_of(table(spark, sf_dir, "events"))


def plays_of(events: DataFrame) -> DataFrame:
    """play_events() of rows of the events table, a stream of them as well."""
    song = F.get_json_object("props", "$.k").cast("bigint")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", song.alias("song_id"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("listener"),
        "song_id",
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("played_at"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("played_ms"),
        (F.lit(60000) + (F.col("song_id") % 5) * 15000).cast("bigint").alias("duration_ms"),
        "event_type",
    )


def fraction(played: Column, duration: Column) -> Column:
    """How much of a track was heard: 0 where its length is unknown."""
    return F.when(duration <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), played.cast("double") / duration)))


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).where(F.col("song_id") % 17 == 0).select("song_id")


def dislikes(spark: SparkSession, sf_dir: str, listener: int = 3) -> DataFrame:
    return play_events(spark, sf_dir).where((F.col("event_type") == "error") & (F.col("listener") == listener)).select("song_id").distinct()


def legacy_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors once stored as JSON text; null, empty and unreadable ones are dropped."""
    read = rows.withColumn(column, F.from_json(column, "array<float>", {"mode": "PERMISSIVE"}))
    return read.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull()))


def current(rows: DataFrame, version: int = ANALYSIS_VERSION, column: str = "analysis_version") -> DataFrame:
    """Rows of the current analysis; those of any other version count as not analysed."""
    return rows.where(F.col(column) == version)


def upserted(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The latest row of each key, as replace-on-conflict leaves it."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)))
    return ranked.where("__rank = 1").drop("__rank")
