"""The library scan as a stream: files come, those not yet analysed are, and their vectors replace older ones in a store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import audio
from ..sources.tables import ANALYSIS_VERSION

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """Rows of which the newest of each key counts, in a folder that streams write batch by batch.

    A batch is a folder of its own, named by its stream and number, which a repeated batch overwrites: a stream
    that died after writing and before it told so leaves no row twice. Readers take the newest row of
    a key by the columns newest, so batches may come in any order; ties go by the other columns.
    """

    def __init__(self, path: str, schema: str, keys: list[str], newest: list[str]) -> None:
        self.path, self.schema, self.keys, self.newest = path.rstrip("/"), schema, keys, newest

    def _folder(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _rows(self, spark: SparkSession) -> DataFrame:
        files, path = self._folder(spark)
        fields = f"{self.schema}, stream string, batch bigint"
        return spark.read.schema(fields).parquet(self.path) if files.exists(path) else spark.createDataFrame([], fields)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, by an aggregate: tasks keep the newest they have before rows are shuffled."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        others = [c for c in names if c not in (*self.keys, *self.newest)]
        newest = F.max(F.struct(*self.newest, *others)).alias("__newest")
        return rows.groupBy(*self.keys).agg(newest).select(*[F.col(c) if c in self.keys else F.col(f"__newest.{c}") for c in names])

    def latest(self, spark: SparkSession) -> DataFrame:
        return self._latest(self._rows(spark))

    def before(self, spark: SparkSession, stream: str, batch: int) -> DataFrame:
        """What the store holds but for a batch itself, of which a broken run may have left rows, and what came after it."""
        return self._latest(self._rows(spark).where((F.col("stream") != stream) | (F.col("batch") < batch)))

    def put(self, rows: DataFrame, stream: str, batch: int) -> None:
        self._latest(rows).write.mode("overwrite").parquet(f"{self.path}/stream={stream}/batch={batch}")

    def count(self, spark: SparkSession) -> int:
        return self.latest(spark).count()

    def clear(self, spark: SparkSession) -> None:
        """Delete all rows; streams that have read their files already do not bring them back, so a new scan takes a new checkpoint."""
        files, path = self._folder(spark)
        files.delete(path, True)


def upserts(rows: DataFrame, store: Store, checkpoint: str, change: Change | None = None, then: Callable[[int], None] | None = None, name: str | None = None) -> StreamingQuery:
    """A stream of rows into the store, until what is there has been read; a later run with the same checkpoint goes on from there.

    change(batch, stored) makes the rows to store of a batch and of what was stored before it. then(number) is
    called once a batch is stored. The stream's name in the store hangs on the checkpoint.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, number: int) -> None:
        made = batch if change is None else change(batch, store.before(batch.sparkSession, stream, number))
        store.put(made, stream, number)
        if then is not None:
            then(number)

    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


#: Rows of Spark's reader of whole files.
FILES = "path string, modificationTime timestamp, length bigint, content binary"
VECTORS = "song_id bigint, version int, modified timestamp, vector array<float>"


def vector_store(path: str) -> Store:
    """Vectors of tracks, the one of the newest analysis and then of the newest file."""
    return Store(path, VECTORS, ["song_id"], ["version", "modified"])


def to_scan(files: DataFrame, library: DataFrame, stored: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """files (path, modified and others, but no song_id) of the library (song_id, path) of which no vector of the version and as new is stored; with song_id."""
    known = stored.where(F.col("version") == version).select(F.col("song_id").alias("__song"), F.col("modified").alias("__modified"))
    named = files.join(library.select("song_id", "path"), "path")
    return named.join(known, (F.col("song_id") == F.col("__song")) & (F.col("__modified") >= F.col("modified")), "left_anti")


def scan(media: str, library: DataFrame, store: Store, checkpoint: str, encode=None, per_batch: int = 64, version: int = ANALYSIS_VERSION, then: Callable[[int], None] | None = None, pattern: str = "*.wav") -> StreamingQuery:
    """Analyse the files of a folder that are tracks of the library and not yet analysed, per_batch at a time; stopped, it goes on where it was.

    A file that cannot be decoded gets a zero vector, so that it counts as analysed. Files that are
    changed are new ones. encode is that of audio.analysed. The files, their bytes and those stored are metrics of the
    stream under the name scan.
    """
    spark = library.sparkSession
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(media)
    told = files.observe("scan", F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    # Spark names a local file as file:/x; libraries do as file:///x or /x.
    bare = F.regexp_replace("path", "^file:/+", "/")
    rows = told.select(bare.alias("path"), "content", F.col("modificationTime").alias("modified"))

    def change(batch: DataFrame, stored: DataFrame) -> DataFrame:
        left = to_scan(batch, library.withColumn("path", bare), stored, version)
        found = audio.analysed(left.select("path", "content", "song_id", "modified"), encode)
        return found.select("song_id", F.lit(version).alias("version"), "modified", "vector")

    return upserts(rows, store, checkpoint, change, then)


class Progress(StreamingQueryListener):
    """What streams' metrics under a name come to: done of total, seconds so far, seconds a row, and seconds left.

    Add it by spark.streams.addListener. Rows are those of the field given; a batch that is repeated counts again, as its
    work is done again.
    """

    def __init__(self, total: int, name: str = "scan", field: str = "files") -> None:
        self.total, self.name, self.field = total, name, field
        self.done, self.seconds, self.batches, self.ended = 0, 0.0, 0, 0

    @property
    def pace(self) -> float | None:
        return self.seconds / self.done if self.done else None

    @property
    def left(self) -> float | None:
        return None if self.pace is None else max(0, self.total - self.done) * self.pace

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress.observedMetrics.get(self.name)
        if told is not None and told[self.field]:
            self.done += told[self.field]
            self.seconds += event.progress.batchDuration / 1000
            self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1
