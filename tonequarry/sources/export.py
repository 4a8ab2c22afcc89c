"""Import and export: TSV libraries, JSON documents, tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .tables import ALBUMS_DOCUMENT, DAILY_DOCUMENT, PREFERENCES


def _clean(c):
    return F.regexp_replace(c, "[\t\n\r]", " ")


def library_lines(songs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(title, artist, folder, vector): a row to a song, the vector's numbers joined by commas; distinct songs with a non-zero vector."""
    rows = songs.dropDuplicates(["song_id"]).join(tracks.where(~V.is_zero(F.col("vector"))).select("song_id", "vector"), "song_id")
    joined = F.array_join(F.col("vector").cast("array<string>"), ",")
    return rows.select("song_id", _clean("title").alias("title"), _clean("artist").alias("artist"), _clean("folder").alias("folder"), joined.alias("vector"))


def write_tsv(lines: DataFrame, path: str) -> None:
    lines.drop("song_id").write.option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("quote", "").schema("title string, artist string, folder string, vector string").csv(path)
    return with_vectors(rows)


def with_vectors(lines: DataFrame) -> DataFrame:
    return lines.withColumn("vector", F.transform(F.split("vector", ","), lambda x: x.cast("float")))


def daily_document(day: DataFrame) -> DataFrame:
    """(doc): the playlist of a day and those remembered, as JSON. day: day, attempt, ids, recent."""
    return day.select(F.to_json(F.struct("day", "attempt", "ids", "recent")).alias("doc"))


def daily_from(docs: DataFrame) -> DataFrame:
    """The playlists that documents hold; an unreadable document is none."""
    read = F.from_json("doc", DAILY_DOCUMENT, {"mode": "PERMISSIVE"})
    return docs.select(read.alias("d")).where(F.col("d.day").isNotNull()).select("d.*")


def albums_from(docs: DataFrame, signature: str) -> DataFrame:
    """(label, song_id) of the albums document that has the signature; any other is out of date."""
    read = F.from_json("doc", ALBUMS_DOCUMENT, {"mode": "PERMISSIVE"})
    rows = docs.select(read.alias("d")).where(F.col("d.signature") == signature).select(F.explode("d.albums").alias("a"))
    return rows.select("a.label", F.explode("a.songIds").alias("song_id"))


def deleted(songs: DataFrame, tombstones: DataFrame) -> DataFrame:
    return songs.join(tombstones.select("song_id"), "song_id", "left_anti")


def preferences_from(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(kind, name, position, song_id) of stored preferences; name is a playlist's. Null and unreadable ones hold nothing."""
    read = docs.select(F.from_json(column, PREFERENCES).alias("p"))
    plain = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), F.col(f"p.{kind}").alias("ids"))
    lists = F.transform(F.coalesce("p.playlists", F.array().cast("array<struct<name:string,ids:array<bigint>>>")), lambda x: F.struct(F.lit("playlists").alias("kind"), x["name"].alias("name"), x["ids"].alias("ids")))
    kinds = read.select(F.explode(F.concat(F.array(*(plain(k) for k in ("favourites", "dislikes", "queue"))), lists)).alias("k")).select("k.*")
    return kinds.select("kind", "name", F.posexplode("ids").alias("position", "song_id")).where(F.col("song_id").isNotNull())
