"""Results stored under a key, for as long as the key is that of their inputs: label vectors, albums, documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession, store: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What the store, a folder, has under the key; else what build() makes, which is stored there.

    The key names all that the result depends on, such as a model's fingerprint with the number of labels, or
    the signature of an album build. A result counts once its writer has finished, so one that was broken off
    is built anew.
    """
    path = f"{store.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
