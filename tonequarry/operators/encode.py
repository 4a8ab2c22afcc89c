"""Encoders of texts and sounds as batched inference: a model is loaded once a worker, and a row that it fails on does not fail the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from . import audio

#: load() gives predict(batch), which gives a matrix of a row for each of the batch. It runs in the worker.
Load = Callable[[], Callable[[np.ndarray], np.ndarray]]
VECTOR = T.ArrayType(T.FloatType())
#: Of a file's features.
FRAMES = audio.SAMPLES // audio.HOP + 1


def guarded(load: Load, size: int) -> Load:
    """load with a row of NaN for each input that the model fails on or gives no finite vector for; all, if it can't be loaded."""

    def make():
        try:
            predict = load()
        except Exception:  # noqa: BLE001  a model is foreign code, and its absence is a result
            predict = None

        def one(batch: np.ndarray) -> np.ndarray:
            out = np.asarray(predict(batch), dtype=np.float32).reshape(len(batch), size)
            return np.where(np.isfinite(out).all(1, keepdims=True), out, np.nan)

        def run(batch: np.ndarray) -> np.ndarray:
            none = np.full((len(batch), size), np.nan, dtype=np.float32)
            if predict is None:
                return none
            try:
                return one(batch)
            except Exception:  # noqa: BLE001
                # One by one, so that only those that fail are lost.
                for k in range(len(batch)):
                    try:
                        none[k] = one(batch[k : k + 1])[0]
                    except Exception:  # noqa: BLE001, S112
                        continue
                return none

        return run

    return make


def _unit(raw: Column) -> Column:
    """The unit vector, null where the model failed."""
    return F.when(~F.exists(raw, F.isnan), V.normalized(raw).cast(VECTOR))


def text_vectors(rows: DataFrame, latin: Load | None, cyrillic: Load | None, size: int, text: str = "text", vector: str = "vector", batch: int = 64) -> DataFrame:
    """rows with the unit vector of a text: by one encoder if the text has a Cyrillic letter, else by the other.

    Null where there is no such encoder, the text is null, or the model fails; callers then search by words. Each
    encoder gets its own rows alone: a model is no column that a condition could leave out.
    """
    route = F.coalesce(X.is_cyrillic(F.col(text)), F.lit(False))
    none = F.lit(None).cast(VECTOR)
    parts = [rows.where(F.col(text).isNull()).withColumn(vector, none)]
    for load, own in ((latin, ~route), (cyrillic, route)):
        part = rows.where(own & F.col(text).isNotNull())
        if load is None:
            parts.append(part.withColumn(vector, none))
        else:
            model = predict_batch_udf(guarded(load, size), return_type=VECTOR, batch_size=batch)
            parts.append(part.withColumn("__raw", model(F.col(text))).withColumn(vector, _unit(F.col("__raw"))).drop("__raw"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def features(files: DataFrame) -> DataFrame:
    """(path, features): the flattened log-mel features of files (path, content); null where a file cannot be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A file's features are a quarter of a megabyte, so they leave one by one.
            for path, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                pcm = audio.excerpt(data) if data else None
                own = None if pcm is None else audio.log_mel(pcm).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([own], pa.list_(pa.float32()))], ["path", "features"])

    return files.select("path", "content").mapInArrow(run, "path string, features array<float>")


def sound_vectors(files: DataFrame, load: Load, size: int = 512, batch: int = 8) -> DataFrame:
    """(path, vector): the unit vector of each file by an encoder of (n, 1, frames, bands); zeros where decoding or the model fails, so that the file counts as analysed."""
    made = features(files)
    model = predict_batch_udf(guarded(lambda: _shaped(load()), size), return_type=VECTOR, batch_size=batch, input_tensor_shapes=[[FRAMES * audio.BANDS]])
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    read = made.where(F.col("features").isNotNull()).select("path", model("features").alias("raw")).select("path", F.coalesce(_unit(F.col("raw")), zeros).alias("vector"))
    return read.unionByName(made.where(F.col("features").isNull()).select("path", zeros.alias("vector")))


def _shaped(predict: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda flat: predict(flat.reshape(len(flat), 1, FRAMES, audio.BANDS))
