"""Stored databases of any schema version, read as the current one: a chain of migrations from what their files' footers say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio
from .tables import EMBEDDINGS, PLAY_EVENTS, legacy_vectors

CURRENT, STAMP = 4, "schema_version"
Tables = dict[str, DataFrame]


def _vectors_as_bytes(tables: Tables) -> Tables:
    """1 to 2: vectors as JSON text become bytes; unreadable ones go."""
    return tables | {"embeddings": audio.encoded(legacy_vectors(tables["embeddings"].select(F.col("songId").alias("song_id"), "vector"))).withColumnRenamed("song_id", "songId")}


def _history(tables: Tables) -> Tables:
    """2 to 3: a history of listens, empty at first."""
    spark = tables["embeddings"].sparkSession
    return tables | {"play_events": spark.createDataFrame([], "id bigint, songId bigint, playedAt bigint, playedMs bigint, durationMs bigint")}


def _same(tables: Tables) -> Tables:
    """3 to 4: rows stay as they are; what changed is an index, which here is the order that files are written in."""
    return tables


MIGRATIONS: dict[int, Callable[[Tables], Tables]] = {1: _vectors_as_bytes, 2: _history, 3: _same}


def written_as(tables: Tables, path: str, version: int = CURRENT) -> None:
    """Write the tables of a version, whose footers will say so; listens are in the order of their time within files."""
    for name, rows in tables.items():
        stamped = rows.select(*[F.col(c).alias(c, metadata={STAMP: version}) for c in rows.columns])
        ordered = stamped.sortWithinPartitions("playedAt") if name == "play_events" else stamped
        ordered.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def version_of(embeddings: DataFrame) -> int:
    """What the footers say; of files that say nothing, 1 if vectors are text and else 2, as then there is no history."""
    field = embeddings.schema["vector"]
    return field.metadata.get(STAMP, 1 if field.dataType.simpleString() == "string" else 2)


def migrated(spark: SparkSession, path: str) -> Tables:
    """embeddings (EMBEDDINGS) and play_events (PLAY_EVENTS) of a stored database, taken up from its version step by step. A newer version than the current one is refused."""
    base = path.rstrip("/")
    tables = {"embeddings": spark.read.parquet(f"{base}/embeddings")}
    version = version_of(tables["embeddings"])
    if not 1 <= version <= CURRENT:
        raise ValueError(f"{path} is of version {version}; {CURRENT} is the last known")
    if version >= 3:
        tables["play_events"] = spark.read.parquet(f"{base}/play_events")
    for step in range(version, CURRENT):
        tables = MIGRATIONS[step](tables)
    vectors = audio.decoded(tables["embeddings"].select(F.col("songId").alias("song_id"), "vector"))
    events = tables["play_events"].select("id", F.col("songId").alias("song_id"), F.col("playedAt").alias("played_at"), F.col("playedMs").alias("played_ms"), F.col("durationMs").alias("duration_ms"))
    as_is = lambda rows, schema: rows.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in schema])
    return {"embeddings": as_is(vectors, EMBEDDINGS), "play_events": as_is(events, PLAY_EVENTS)}


def create_tables(spark: SparkSession, database: str) -> None:
    """The current tables in the catalog, where they are not there yet; listens are bucketed by song and sorted by time."""
    fields = lambda schema: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.embeddings ({fields(EMBEDDINGS)}) USING parquet TBLPROPERTIES ('{STAMP}' = '{CURRENT}')")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.play_events ({fields(PLAY_EVENTS)}) USING parquet CLUSTERED BY (song_id) SORTED BY (played_at) INTO 16 BUCKETS TBLPROPERTIES ('{STAMP}' = '{CURRENT}')")
