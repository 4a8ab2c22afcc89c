"""Whether the hour matters: sittings, a permutation test of whole sittings, and profiles that leave a day out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

GAP_MS, ROUNDS = 30 * 60_000, 999


SLOTS = ("night", "morning", "day", "evening")


def slot_of(played_at: Column) -> Column:
    """The part of the day, by the session's time zone, of a time in milliseconds."""
    hour = F.hour(F.timestamp_millis(played_at))
    return F.when(hour < 5, "night").when(hour < 12, "morning").when(hour < 18, "day").otherwise("evening")


def _slot_code() -> Column:
    """slot_of() played_at as a place in SLOTS."""
    return F.array_position(F.array(*map(F.lit, SLOTS)), slot_of(F.col("played_at"))) - 1


def sat(listens: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """listens (listener, played_at, ...) with sitting: listens of a listener that are no further apart than the gap share one, numbered from 1."""
    order = Window.partitionBy("listener").orderBy("played_at", "id")
    apart = F.coalesce(F.col("played_at") - F.lag("played_at").over(order) > gap_ms, F.lit(True))
    return listens.withColumn("sitting", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


#: Listens of a bucket of listeners, about, and rows of vectors that a task takes at once.
IN_BUCKET, AT_ONCE = 1 << 17, 1 << 14


def _by_listeners(rows: DataFrame, tracks: DataFrame, numbers: list[str], run: Callable[[np.ndarray, dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(vectors, columns) of buckets of listeners: rows (listener, song_id, numbers), whole numbers all, sorted by them; song is a row of vectors, or -1 where there is none.

    A listener is in one bucket. A vector is shuffled once for each bucket that has heard the song, not for each listen, and a
    listen as its numbers, which are also all that a task holds of it.
    """
    names = ["listener", *numbers, "song_id"]
    light = rows.where(F.col("listener").isNotNull()).select(*(F.col(c).cast("bigint").alias(c) for c in names))
    buckets = max(1, -(-light.count() // IN_BUCKET))
    light = light.withColumn("bucket", F.pmod(F.xxhash64("listener"), F.lit(buckets)).cast("int"))
    known = light.select("bucket", "song_id").distinct().join(tracks.select("song_id", "vector"), "song_id")
    known = known.select(*(F.col(c) if c == "song_id" else F.lit(None).cast("bigint").alias(c) for c in names), "bucket", "vector")
    both = light.withColumn("vector", F.lit(None).cast(tracks.schema["vector"].dataType)).unionByName(known)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, told = [np.empty(0, np.int64)], [], {c: [] for c in names}
        for batch in batches:
            of = pa.Table.from_batches([batch])
            has = of["vector"].is_valid()
            songs, listens = of.filter(has), of.filter(pc.invert(has))
            if songs.num_rows:
                ids.append(songs["song_id"].to_numpy())
                vectors.append(np.concatenate([np.asarray(c.flatten()) for c in songs["vector"].chunks]).reshape(songs.num_rows, -1))
            for c in names:
                told[c].append(listens[c].fill_null(-1).to_numpy())
        if not vectors:
            return
        known = np.concatenate(ids)
        order = np.argsort(known)
        known, x = known[order], np.concatenate(vectors)[order]
        columns = {c: np.concatenate(told.pop(c)) for c in names}
        at = np.minimum(np.searchsorted(known, columns["song_id"]), len(known) - 1)
        columns["song"] = np.where(known[at] == columns.pop("song_id"), at, -1)
        sort = np.lexsort([columns[c] for c in reversed(["listener", *numbers])])
        yield from run(x, {c: v[sort] for c, v in columns.items()})

    return both.groupBy("bucket").applyInArrow(whole, schema)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted columns begin."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _summed(x: np.ndarray, song: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """The sum of the songs' vectors of each of n runs, whose numbers ascend along song."""
    out = np.zeros((n, x.shape[1]))
    for at in range(0, len(song), AT_ONCE):
        own = run[at : at + AT_ONCE]
        begun = _begins(own)
        out[own[begun]] += np.add.reduceat(x[song[at : at + AT_ONCE]].astype(np.float64), begun, axis=0)
    return out


def sittings(listens: DataFrame, tracks: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(listener, sitting, slot, n, total): each sitting's part of the day, by its first listen, its listens with a vector, and the sum of those."""
    rows = sat(listens, gap_ms).select("listener", "sitting", F.coalesce("played_at", F.lit((1 << 63) - 1)).alias("played_at"), _slot_code().alias("slot"), "song_id")

    def run(x: np.ndarray, of: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = _begins(of["listener"], of["sitting"])
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of["song"]))))
        heard = of["song"] >= 0
        count = np.bincount(number[heard], minlength=len(first))
        ends = np.append(first, len(of["song"]))
        for at in range(0, len(first), AT_ONCE // 4):
            some = slice(ends[at], ends[min(at + AT_ONCE // 4, len(first))])
            n = min(AT_ONCE // 4, len(first) - at)
            mine = heard[some]
            total = _summed(x, of["song"][some][mine], number[some][mine] - at, n)
            k = np.flatnonzero(count[at : at + n])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * x.shape[1]), pa.array(total[k].ravel()))
            begun = first[at + k]
            yield pa.RecordBatch.from_arrays([pa.array(of["listener"][begun]), pa.array(of["sitting"][begun]), pa.array([SLOTS[c] for c in of["slot"][begun]], pa.string()), pa.array(count[at + k]), lists], ["listener", "sitting", "slot", "n", "total"])

    return _by_listeners(rows, tracks, ["sitting", "played_at", "slot"], run, "listener bigint, sitting bigint, slot string, n bigint, total array<double>")


def draws(seed: int, listener: int, sitting: int, rounds: int) -> np.ndarray:
    """A sitting's uniform draws, one a round: the same wherever and in whatever order sittings are taken."""
    return np.random.Generator(np.random.Philox(key=[seed, (listener << 32) ^ sitting])).random(rounds)


def permuted(rows: DataFrame, one: str, other: str, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(sittings, distance, as_far, rounds, p): how far apart the mean vectors of two parts of the day are, and in how many random deals they are as far.

    rows are of sittings(). A round deals whole sittings, as the listens of one are alike, to the first part with
    the chance of its share. Tasks sum up all rounds at once, a few numbers for each round and part, and pass on
    the sums alone. p counts the parts themselves as a round. Without sittings of either part there is no row.
    """
    both = rows.where(F.col("slot").isin(one, other)).select("listener", "sitting", (F.col("slot") == one).alias("first"), "n", "total")
    share = both.agg(F.avg(F.col("first").cast("double"))).first()[0]
    spark = rows.sparkSession
    schema = "sittings bigint, distance double, as_far bigint, rounds int, p double"
    if share is None or share in (0.0, 1.0):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            listener, sitting, first, n, total = (batch.column(k) for k in range(5))
            x = np.concatenate((np.asarray(n, dtype=float)[:, None], np.asarray(total.flatten(), dtype=float).reshape(batch.num_rows, -1)), axis=1)
            deal = np.empty((batch.num_rows, rounds + 1))
            deal[:, 0] = np.asarray(first.cast(pa.int8()))
            for k, (a, b) in enumerate(zip(listener.to_pylist(), sitting.to_pylist(), strict=True)):
                deal[k, 1:] = draws(seed, a, b, rounds) < share
            held = deal.T @ x if held is None else held + deal.T @ x
            whole = x.sum(0) if whole is None else whole + x.sum(0)
            count += batch.num_rows
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, rounds + 1), pa.int32()), pa.array([count] * (rounds + 2)), pa.array([whole.tolist(), *held.tolist()], pa.list_(pa.float64()))], ["round", "count", "sums"])

    told = both.mapInArrow(run, "round int, count bigint, sums array<double>")
    sums = V.elementwise(told, "sums", ["round"], F.sum, alias="sums").join(told.groupBy("round").agg(F.sum("count").alias("count")), "round")

    def judged(table: pa.Table) -> pa.Table:
        by = {r["round"]: np.asarray(r["sums"]) for r in table.to_pylist()}
        whole = by[-1]
        distance = np.full(rounds + 1, -1.0)
        for k in range(rounds + 1):
            a, b = by[k], whole - by[k]
            # A deal that leaves a part without listens is no further apart than any.
            if a[0] > 0.5 and b[0] > 0.5:
                distance[k] = np.sqrt((((a[1:] / a[0]) - (b[1:] / b[0])) ** 2).sum())
        far = int((distance[1:] >= distance[0] - 1e-12).sum())
        return pa.table({"sittings": pa.array([table["count"][0].as_py()]), "distance": [distance[0]], "as_far": pa.array([far]), "rounds": pa.array([rounds], pa.int32()), "p": [(far + 1) / (rounds + 1)]})

    return sums.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(judged, schema)


def left_out(listens: DataFrame, tracks: DataFrame) -> DataFrame:
    """(slot, n, same, any, wins): how well other days foretell a listen, by the listens of the same part of the day and by all.

    Each listen's vector is compared, by cosine, with the sum of its listener's listens on other days: those of the
    same part of the day, and all. same and any are the means, wins the share for which the same part tells more. Listens
    without another of their part on another day are left out.
    """
    day = F.datediff(F.to_date(F.timestamp_millis("played_at")), F.lit("1970-01-01").cast("date"))
    rows = listens.where(F.col("played_at").isNotNull()).select("listener", _slot_code().alias("slot"), day.alias("day"), "song_id")

    def run(x: np.ndarray, of: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        of = {c: v[of["song"] >= 0] for c, v in of.items()}
        listeners = np.append(_begins(of["listener"]), len(of["song"])) if len(of["song"]) else np.zeros(1, dtype=int)
        told = np.zeros((len(SLOTS), 4))
        at = 0
        while at < len(listeners) - 1:
            # Whole listeners, of AT_ONCE listens together, or one that has more.
            to = max(at + 1, int(np.searchsorted(listeners, listeners[at] + AT_ONCE, "right")) - 1)
            told += _foretold(x, *(of[c][listeners[at] : listeners[to]] for c in ("listener", "slot", "day", "song")))
            at = to
        some = np.flatnonzero(told[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([SLOTS[k] for k in some], pa.string()), pa.array(told[some, 0].astype(np.int64)), *(pa.array(told[some, k]) for k in (1, 2, 3))], ["slot", "n", "same", "any", "wins"])

    told = _by_listeners(rows, tracks, ["slot", "day"], run, "slot string, n bigint, same double, any double, wins double")
    mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    return told.groupBy("slot").agg(mean("same"), mean("any"), mean("wins"), F.sum("n").alias("n")).select("slot", "n", "same", "any", "wins")


def _foretold(x: np.ndarray, listener: np.ndarray, slot: np.ndarray, day: np.ndarray, song: np.ndarray) -> np.ndarray:
    """For each part of the day the number of listens, and sums of same, any and wins, over whole listeners' listens, sorted by the columns."""
    cells = _begins(listener, slot, day)
    cell = np.repeat(np.arange(len(cells)), np.diff(np.append(cells, len(song))))
    n = np.bincount(cell)
    own = _summed(x, song, cell, len(cells))
    # Coarser sums from the finer; what is left out is taken from the whole.
    who, part, when = listener[cells], slot[cells], day[cells]
    _, by_part = np.unique(np.stack((who, part)), axis=1, return_inverse=True)
    _, by_day = np.unique(np.stack((who, when)), axis=1, return_inverse=True)
    _, by_all = np.unique(who, return_inverse=True)

    def whole(group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        begun = _begins(group[order])
        return np.add.reduceat(own[order], begun, axis=0)[group]

    more = np.bincount(by_part, n)[by_part] > n
    every = whole(by_all) - whole(by_day)
    same = whole(by_part) - own
    keep = np.flatnonzero(more[cell])
    told = np.zeros((len(SLOTS), 4))
    for at in range(0, len(keep), AT_ONCE):
        k = keep[at : at + AT_ONCE]
        v = x[song[k]].astype(np.float64)
        a, b = _cosines(v, same[cell[k]]), _cosines(v, every[cell[k]])
        told += np.stack([np.bincount(slot[k], w, len(SLOTS)) for w in (None, a, b, a > b + 1e-12)], axis=1)
    return told


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 0 where either is zero."""
    below = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(below > 0, np.einsum("ij,ij->i", a, b) / np.where(below > 0, below, 1.0), 0.0)
