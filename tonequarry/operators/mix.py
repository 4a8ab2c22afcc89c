"""The playlist of the day: who may be in it, what it is built around, and a diverse choice in a smooth order."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..session import written
from ..sources.tables import DAY

SIZE, ANCHORS, ANCHOR_FLOOR = 28, 4, 0.01
FRESH_SHARE, FRESH_DAYS, REPEAT_DAYS, REJECTED = 0.4, 30, 3, -0.5
RELEVANCE, PER_GROUP, TOO_CLOSE, SHORTLIST, PULL = 0.75, 2, 0.99, 300, 0.15
MIN_LIBRARY, REMEMBERED_DAYS, MISSING_ALLOWED = 40, 7, 2


def is_fresh(last_played: Column, now: int) -> Column:
    return last_played.isNull() | (F.lit(now) - last_played > FRESH_DAYS * DAY)


def eligible(tracks: DataFrame, weights: DataFrame, offered: DataFrame, favourites: DataFrame, now: int, excluded: DataFrame | None = None) -> DataFrame:
    """tracks (song_id, last_played, ...) with weight, that were not offered or played of late and not rejected; all, if none is left.

    excluded holds tracks that are never to come; the reference behaviour is none.
    """
    rows = tracks.join(weights.select("song_id", "weight"), "song_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    flag = lambda df, name: df.select("song_id", F.lit(True).alias(name)).distinct()
    rows = rows.join(flag(offered, "__offered"), "song_id", "left").join(flag(favourites, "__favourite"), "song_id", "left")
    rested = F.col("last_played").isNull() | (F.lit(now) - F.col("last_played") > REPEAT_DAYS * DAY)
    good = F.col("__offered").isNull() & rested & ((F.col("weight") > REJECTED) | F.col("__favourite").isNotNull())
    if excluded is not None:
        rows = rows.join(excluded.select("song_id"), "song_id", "left_anti")
    rows = rows.withColumn("__good", good)
    some = rows.agg(F.coalesce(F.max("__good"), F.lit(False)).alias("__some"))
    return rows.crossJoin(F.broadcast(some)).where(F.col("__good") | ~F.col("__some")).drop("__good", "__some", "__offered", "__favourite")


def anchors(candidates: DataFrame, seed: int, n: int = ANCHORS) -> DataFrame:
    """n draws without replacement by weight, from the liked tracks or else from all: least exponential keys win."""
    some = candidates.agg(F.coalesce(F.max(F.col("weight") > 0), F.lit(False)).alias("__liked"))
    pool = candidates.crossJoin(F.broadcast(some)).where((F.col("weight") > 0) | ~F.col("__liked")).drop("__liked")
    key = -F.log(X.hash_uniform(seed, F.col("song_id"))) / F.greatest(F.col("weight"), F.lit(ANCHOR_FLOOR))
    return pool.withColumn("draw", key).orderBy("draw", "song_id").limit(n)


def candidate_scores(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """candidates with score: closest anchor's product, pulled by taste. Anchors are a handful, collected into one row."""
    row = chosen.agg(F.collect_list("vector").alias("__anchors"))
    near = F.array_max(F.transform("__anchors", lambda a: V.dot(F.col("vector"), a)))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("weight")))
    return candidates.crossJoin(F.broadcast(row)).withColumn("score", near + PULL * clamped).drop("__anchors")


def shortlist(candidates: DataFrame, chosen: DataFrame, k: int = SHORTLIST) -> DataFrame:
    return candidate_scores(candidates, chosen).orderBy(F.desc("score"), "song_id").limit(k)


def choose(rows: pd.DataFrame, size: int = SIZE) -> list[int]:
    """Row numbers, in the order picked: relevant but unlike what was picked, within quotas.

    rows: vector, score, grp, duplicate_key, fresh, best first. A group has a quota, which rises when
    only the quota stands in the way of every track; it ends when raising it can free none.
    """
    n = len(rows)
    x = np.stack(rows["vector"].to_numpy()) if n else np.zeros((0, 1))
    score, fresh = rows["score"].to_numpy(dtype=float), rows["fresh"].to_numpy(dtype=bool)
    group, group_of = np.unique(rows["grp"].fillna("").to_numpy(dtype=str), return_inverse=True)
    keys = rows["duplicate_key"].fillna("").to_numpy(dtype=str)
    quota = max(PER_GROUP, math.ceil(size / max(1, len(group))))
    wanted = int(FRESH_SHARE * size)
    used_keys: set[str] = set()
    used = np.zeros(len(group), dtype=int)
    nearest = np.full(n, -np.inf)
    open_ = np.ones(n, dtype=bool)
    picked: list[int] = []
    while len(picked) < size:
        only_fresh = size - len(picked) <= wanted - int(fresh[picked].sum())
        free = open_ & (nearest <= TOO_CLOSE) & np.array([not k or k not in used_keys for k in keys], dtype=bool)
        if only_fresh:
            free &= fresh
        within = free & (used[group_of] < quota)
        if not within.any():
            if not free.any():
                break
            quota += 1
            continue
        value = RELEVANCE * score - (1 - RELEVANCE) * np.where(np.isfinite(nearest), nearest, 0.0)
        best = int(np.argmax(np.where(within, value, -np.inf)))
        picked.append(best)
        open_[best] = False
        used[group_of[best]] += 1
        if keys[best]:
            used_keys.add(keys[best])
        nearest = np.maximum(nearest, x @ x[best])
    return picked


def tour(x: np.ndarray) -> list[int]:
    """An order in which neighbours are alike: from the least typical, always on to the nearest left."""
    n = len(x)
    if n <= 2:
        return list(range(n))
    near = x @ x.T
    at = int(np.argmin(near.sum(1)))
    out, left = [at], set(range(n)) - {at}
    while left:
        at = max(left, key=lambda j: (near[at, j], -j))
        out.append(at)
        left.remove(at)
    return out


def sequenced(candidates: DataFrame, *keys: str, size: int = SIZE) -> DataFrame:
    """(keys, position, song_id) of each group of shortlisted candidates: at most SHORTLIST rows each."""
    names = list(keys)

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "song_id"], ascending=[False, True]).reset_index(drop=True)
        picked = choose(rows, size)
        x = np.stack(rows["vector"].to_numpy()[picked]) if picked else np.zeros((0, 1))
        ids = [int(rows["song_id"][picked[k]]) for k in tour(x)]
        return pd.DataFrame({**{n: v for n, v in zip(names, [[k] * len(ids) for k in key], strict=True)}, "position": np.arange(len(ids)), "song_id": ids})

    kinds = "".join(f"{n} {candidates.schema[n].dataType.simpleString()}, " for n in names)
    return candidates.groupBy(*names).applyInPandas(run, f"{kinds}position bigint, song_id bigint")


def daily_mix(tracks: DataFrame, weights: DataFrame, offered: DataFrame, favourites: DataFrame, now: int, seed: int, excluded: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """(position, song_id). tracks: song_id, vector, grp, duplicate_key, last_played. A library of no more than size is returned whole."""
    few = tracks.select("song_id").limit(size + 1).count() <= size
    if few:
        return tracks.select((F.row_number().over(Window.orderBy("song_id")) - 1).cast("long").alias("position"), "song_id")
    pool = written(eligible(tracks, weights, offered, favourites, now, excluded), "pool")  # read for the anchors and for the shortlist
    rows = shortlist(pool, anchors(pool, seed)).withColumn("fresh", is_fresh(F.col("last_played"), now)).withColumn("one", F.lit(1))
    return sequenced(rows.select("one", "song_id", V.doubles(F.col("vector")).alias("vector"), "score", "grp", "duplicate_key", "fresh"), "one", size=size).select("position", "song_id")


def seed_of(day: str, n: int, attempt: int = 0) -> int:
    """A stable seed for a day, a library's size and an attempt."""
    return zlib.crc32(f"{day}:{n}".encode()) + attempt


def keeps_playlist(stored: DataFrame, songs: DataFrame, today: str) -> DataFrame:
    """(keep): whether the stored playlist (day, ids) is of today and all but two of its songs, and one at least, still exist."""
    ids = stored.where(F.col("day") == today).select(F.explode("ids").alias("song_id"))
    have = ids.join(songs.select("song_id"), "song_id", "left_semi").agg(F.count(F.lit(1)).alias("have"))
    return ids.agg(F.count(F.lit(1)).alias("all")).crossJoin(have).select(((F.col("have") > 0) & (F.col("have") >= F.col("all") - MISSING_ALLOWED)).alias("keep"))


def remembered(days: DataFrame, stored: DataFrame, n: int = REMEMBERED_DAYS) -> DataFrame:
    """(day, ids): the stored day first, then the others of before, the latest n."""
    before = days.join(stored.select("day"), "day", "left_anti")
    return stored.select("day", "ids").unionByName(before.select("day", "ids")).orderBy(F.desc("day")).limit(n)


def playlist(stored: DataFrame, songs: DataFrame, today: str, build: Callable[[DataFrame, int], DataFrame], rebuild: bool = False) -> DataFrame:
    """(day, attempt, ids, recent): the stored playlist where it still holds, else a new one.

    stored has these columns and a row at most. A playlist of today stays if keeps_playlist() and no rebuild is
    asked for. A new one is build(offered, attempt), position and song_id, where offered (song_id) are those
    of the days remembered: the stored one first, then the others. attempt grows with each build of a day.
    """
    kept = keeps_playlist(stored, songs, today).first()["keep"]
    if kept and not rebuild:
        return stored
    last = stored.select("day", "attempt").first()
    attempt = last["attempt"] + 1 if last is not None and last["day"] == today else 0
    days = remembered(stored.select(F.explode("recent").alias("d")).select("d.day", "d.ids"), stored)
    built = build(days.select(F.explode("ids").alias("song_id")).distinct(), attempt)
    # A playlist and a few days of them: some tens of ids each.
    ids = built.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "song_id"))), lambda x: x["song_id"]).alias("ids"))
    recent = days.agg(F.reverse(F.array_sort(F.collect_list(F.struct("day", "ids")))).alias("recent"))
    return ids.crossJoin(recent).select(F.lit(today).alias("day"), F.lit(attempt).alias("attempt"), "ids", "recent")
