"""Albums from end to end: what is stored is used while it holds, else clusters are made, named and stored; then titles, subtitles and order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..session import written
from . import albums as A
from . import clustering

#: What an album without a label has for one.
UNNAMED = -1
STORED = "signature string, named boolean, cluster bigint, label int, song_id bigint"
LABELS = "fingerprint string, label int, vector array<double>"


def signature(tracks: DataFrame, variant: str, vocabulary: str, scale: float) -> str:
    """What a build depends on: the set of songs, whatever their order, the model's variant, the vocabulary and the user's scale.

    Songs are summed up by exclusive ors of two hashes, so no task sees them all.
    """
    ids = tracks.select("song_id").distinct()
    r = ids.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("song_id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(5), F.col("song_id"))).alias("two")).first()
    return hashlib.sha256(f"{r['n']}|{r['one']}|{r['two']}|{variant}|{vocabulary}|{scale:.2f}".encode()).hexdigest()


class Files:
    """Small tables in a folder, each replaced as a whole: written beside the old one, which counts until then."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def read(self, name: str, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.files.exists(self._at(f"{name}/_SUCCESS")) else None

    def replace(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        self.files.delete(self._at(name), True)
        self.files.rename(self._at(f"{name}.new"), self._at(name))


def label_vectors(store: Files, prompts: list[str], encode: Callable[[str], list[float] | None] | None) -> DataFrame | None:
    """(label_idx, vector) of a vocabulary: from the store if it is of this vocabulary and whole, else encoded and stored; None without an encoder, or if it fails on any.

    prompts are tens of texts, so they are encoded here.
    """
    fingerprint = hashlib.sha256("\n".join(prompts).encode()).hexdigest()
    known = store.read("labels", LABELS)
    if known is not None:
        own = known.where(F.col("fingerprint") == fingerprint)
        if own.count() == len(prompts) == known.count():
            return own.select(F.col("label").alias("label_idx"), "vector")
    if encode is None:
        return None
    vectors = [encode(p) for p in prompts]
    if any(v is None for v in vectors):
        return None
    store.replace("labels", store.spark.createDataFrame([(fingerprint, k, [float(x) for x in v]) for k, v in enumerate(vectors)], LABELS).coalesce(1))
    return store.read("labels", LABELS).select(F.col("label").alias("label_idx"), "vector")


def presented(members: DataFrame, songs: DataFrame, titles: list[str], untitled: str = "Mix") -> DataFrame:
    """(place, album_id, title, subtitle, size, song_ids) of members (cluster, label, song_id), the largest album first, then the one with the smallest song.

    songs (song_id, title, artist): songs that are not among them are left out. An album without a label of titles is
    the untitled word and its place. Titles do not repeat: the second of a title has its dominant artist, or a number. song_ids
    and titles are in one row and task, as an album holds some tens of songs and a library some hundred albums.
    """
    known = written(members.join(songs.select("song_id", X.artist_of(F.col("artist"), F.col("title")).alias("artist")), "song_id").select("cluster", "label", "artist", F.col("song_id").alias("place")), "members")
    order = A.by_size(known.select("cluster", F.col("place").alias("song_id")))
    base = members.sparkSession.createDataFrame(list(enumerate(titles)), "label int, named string")
    of = known.groupBy("cluster").agg(F.min("label").alias("label"), F.array_sort(F.collect_list("place")).alias("song_ids"), A.set_id(F.collect_list("place")).alias("album_id"))
    rows = written(order.join(of, "cluster").join(base, "label", "left").withColumn("title", F.coalesce("named", F.concat(F.lit(f"{untitled} "), F.col("place").cast("string")))), "albums")
    named = A.titled(rows.join(A.dominant_artist(known), "cluster", "left").select(F.lit(0).cast("long").alias("library"), F.col("place").cast("long").alias("cluster"), "size", "title", "artist"))
    final = named.select(F.col("cluster").alias("place"), "title")
    return rows.drop("title").join(final, "place").join(A.leading_artists(known), "cluster", "left").select(F.col("place").cast("int").alias("place"), "album_id", "title", F.coalesce("subtitle", F.lit("")).alias("subtitle"), "size", "song_ids")


def build_albums(tracks: DataFrame, songs: DataFrame, store: str, variant: str, prompts: list[str], titles: list[str], encode: Callable[[str], list[float] | None] | None = None, scale: float = 1.0, rebuild: bool = False) -> DataFrame:
    """presented() albums of tracks (song_id, vector) that are songs: stored ones while they hold, else made anew and stored.

    Stored ones hold if their signature is that of the library, and they are named or there is still no encoder of texts to name
    them by. rebuild makes them anew in any case. A library of fewer than twice the least album's songs has none.
    """
    spark = tracks.sparkSession
    files = Files(spark, store)
    own = written(tracks.join(songs.select("song_id"), "song_id", "left_semi").dropDuplicates(["song_id"]).select("song_id", "vector"), "tracks")
    if own.limit(2 * A.MIN_SONGS).count() < 2 * A.MIN_SONGS:
        return presented(spark.createDataFrame([], "cluster bigint, label int, song_id bigint"), songs, titles)
    sign = signature(own, variant, "\n".join(prompts), scale)
    stored = None if rebuild else files.read("albums", STORED)
    if stored is not None:
        told = stored.select("signature", "named").first()
        if told is None or told["signature"] != sign or not (told["named"] or encode is None):
            stored = None
    if stored is None:
        found = written(clustering.cluster_tracks(own, scale=scale), "found")
        labels = label_vectors(files, prompts, encode)
        if labels is None:
            label = found.select("cluster", F.lit(UNNAMED).alias("label")).distinct()
        else:
            real = own.where(~V.is_zero(F.col("vector")))
            label = A.named(A.centroids(found, own), labels, V.elementwise(real, "vector", [], F.avg)).select("cluster", F.col("label_idx").cast("int").alias("label"))
        rows = found.join(label, "cluster").select(F.lit(sign).alias("signature"), F.lit(labels is not None).alias("named"), "cluster", "label", "song_id")
        # A library without albums is stored too, by a row that has no song.
        none = spark.createDataFrame([(sign, labels is not None, None, None, None)], STORED)
        files.replace("albums", rows.unionByName(none))
        stored = files.read("albums", STORED)
    return presented(stored.where(F.col("song_id").isNotNull()).select("cluster", "label", "song_id"), songs, titles)
