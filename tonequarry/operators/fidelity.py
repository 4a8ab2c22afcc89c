"""What another model, such as a quantised one, does to a library: how far each track moves, and whether the same tracks stay its neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import written
from .similarity import neighbours

NEAREST = (1, 5, 10)


def compared(tracks: DataFrame, other: DataFrame, queries: DataFrame, ks: tuple[int, ...] = NEAREST, rows_per_block: int = 16_384) -> DataFrame:
    """(query_id, own, shared_<k> for each of ks, place): a row for each of the stated songs queries (query_id).

    tracks and other hold (song_id, vector), the vectors of two models; songs that only one has are left out. own is the
    cosine of a song's two vectors. shared_<k> is how many of its k nearest by tracks are among the k by other. place
    is where other ranks the nearest by tracks, 0 for first; null in a library of one.
    """
    both = written(tracks.select("song_id", V.doubles(F.col("vector")).alias("vector")).join(other.select("song_id", V.doubles(F.col("vector")).alias("other")), "song_id"), "both")
    asked = both.join(queries.select(F.col("query_id").alias("song_id")).distinct(), "song_id", "left_semi").withColumnRenamed("song_id", "query_id")
    changed = lambda df: df.withColumn("vector", F.col("other")).drop("other")
    one = written(neighbours(both.drop("other"), asked.drop("other"), max(ks)).select("query_id", "song_id", "rank"), "nearest")
    two = neighbours(changed(both), changed(asked), max(ks)).select("query_id", "song_id", F.col("rank").alias("other_rank"))
    within = lambda k: F.count_if((F.col("rank") <= k) & (F.col("other_rank") <= k)).alias(f"shared_{k}")
    shared = one.join(two, ["query_id", "song_id"], "left").groupBy("query_id").agg(*map(within, ks))
    first = one.where("rank = 1").join(both.select("song_id", F.col("other").alias("first")), "song_id").select("query_id", "song_id", "first")
    placed = places(changed(both), changed(asked).join(first, "query_id"), rows_per_block)
    rows = asked.select("query_id", V.cosine(F.col("vector"), F.col("other")).alias("own"))
    none = [F.coalesce(f"shared_{k}", F.lit(0)).alias(f"shared_{k}") for k in ks]
    return rows.join(shared, "query_id", "left").join(placed, "query_id", "left").select("query_id", "own", *none, "place")


def places(tracks: DataFrame, asked: DataFrame, rows_per_block: int = 16_384) -> DataFrame:
    """(query_id, place): how many other tracks a query ranks above a given one.

    asked: query_id, vector, and the given track's song_id and vector first. Tracks are dealt to blocks, and queries to
    blocks of which each meets all those of the tracks; a task counts for a pair of blocks, and counts add up.
    """
    others, blocks = (max(1, -(-df.count() // rows_per_block)) for df in (tracks, asked))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.select("query_id", "song_id", "vector", "first", deal("query_id", blocks).alias("i"), every(others).alias("j"))
    right = tracks.select(none("bigint").alias("query_id"), "song_id", "vector", none("array<double>").alias("first"), every(blocks).alias("i"), deal("song_id", others).alias("j"))

    def run(table: pa.Table) -> pa.Table:
        asks = table["query_id"].is_valid().to_numpy()
        ids, x = table["song_id"].to_numpy(), table["vector"].to_numpy(zero_copy_only=False)
        query = table["query_id"].filter(pa.array(asks)).to_numpy()
        above = np.zeros(len(query), dtype=np.int64)
        if asks.any() and not asks.all():
            q, own, wanted = np.stack(x[asks]), ids[~asks], ids[asks]
            block, first = np.stack(x[~asks]), np.stack(table["first"].filter(pa.array(asks)).to_numpy(zero_copy_only=False))
            for at in range(0, len(q), 1024):
                k = slice(at, at + 1024)
                least = (q[k] * first[k]).sum(1)[:, None]
                score = q[k] @ block.T
                better = (score > least) | ((score == least) & (own[None, :] < wanted[k, None]))
                above[k] = (better & (own[None, :] != wanted[k, None]) & (own[None, :] != query[k, None])).sum(1)
        return pa.table({"query_id": pa.array(query, pa.int64()), "above": pa.array(above)})

    return left.unionByName(right).groupBy("i", "j").applyInArrow(run, "query_id bigint, above bigint").groupBy("query_id").agg(F.sum("above").alias("place"))


def agreement(rows: DataFrame, ks: tuple[int, ...] = NEAREST) -> DataFrame:
    """One row of compared(): own_least, own_mean, the share of neighbours kept for each k as top_<k>, place_mean, place_worst."""
    top: list[Column] = [(F.sum(f"shared_{k}") / (F.count(F.lit(1)) * k)).alias(f"top_{k}") for k in ks]
    return rows.agg(F.min("own").alias("own_least"), F.avg("own").alias("own_mean"), *top, F.avg("place").alias("place_mean"), F.max("place").alias("place_worst"))
