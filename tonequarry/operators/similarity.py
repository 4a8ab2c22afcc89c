"""Search by vector and by text, similar tracks, shuffles of a queue, neighbours and pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..session import written
from .blocks import TILE, block_count, joined

#: Scores at and below the floor display as 0, at and above the strong one as 0.99.
FLOOR, STRONG, SHOWN = 0.15, 0.45, 0.99
SEARCH_K, SIMILAR_K, PLAIN_K, SHUFFLE_K = 50, 30, 20, 5


def display(score: Column) -> Column:
    """The score as shown; it falls at the knee, where the line has come close to 1."""
    line = (score - FLOOR) / (STRONG - FLOOR)
    return F.when(score >= STRONG, F.lit(SHOWN)).when(score <= FLOOR, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), line)))


def scored(tracks: DataFrame, query: DataFrame) -> DataFrame:
    """tracks with score, the cosine to the one vector in query; one row is broadcast."""
    one = query.select(F.col("vector").alias("__query")).limit(1)
    return tracks.crossJoin(F.broadcast(one)).withColumn("score", V.cosine(F.col("vector"), F.col("__query"))).drop("__query")


def search_by_vector(tracks: DataFrame, query: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """(song_id, score, shown): the best k whose score reaches mean plus deviation of all, and the floor."""
    all_ = scored(tracks, query).select("song_id", "score")
    cut = all_.agg(F.greatest(F.avg("score") + F.stddev_pop("score"), F.lit(FLOOR)).alias("__cut"))
    kept = all_.crossJoin(F.broadcast(cut)).where(F.col("score") >= F.col("__cut"))
    return kept.select("song_id", "score", display(F.col("score")).alias("shown")).orderBy(F.desc("score"), "song_id").limit(k)


def similar_to(tracks: DataFrame, song_id: int, k: int = SIMILAR_K) -> DataFrame:
    query = tracks.where(F.col("song_id") == song_id)
    return scored(tracks.where(F.col("song_id") != song_id), query).select("song_id", "score").orderBy(F.desc("score"), "song_id").limit(k)


def search_text(songs: DataFrame, query: str, scope: DataFrame | None = None, k: int = PLAIN_K) -> DataFrame:
    """Songs with the query in title or artist, in library order: the first k, or all of a scope (song_id)."""
    hit = songs.where(X.contains(F.col("title"), query) | X.contains(F.col("artist"), query))
    if scope is not None:
        return hit.join(scope.select("song_id"), "song_id", "left_semi").orderBy("title", "song_id")
    return hit.orderBy("title", "song_id").limit(k)


def smart_shuffle(queue: DataFrame, tracks: DataFrame, current: int, k: int = SHUFFLE_K) -> DataFrame:
    """queue (queue_id, position, song_id) anew: up to the current song as it was, its k most similar upcoming ones, the rest.

    Songs without a vector score -1. Each queue is a partition of the windows.
    """
    one = tracks.where(F.col("song_id") == current).select(F.col("vector").alias("__query"))
    at = queue.where(F.col("song_id") == current).groupBy("queue_id").agg(F.min("position").alias("__now"))
    rows = queue.join(at, "queue_id").join(tracks.select("song_id", "vector"), "song_id", "left").join(F.broadcast(one.limit(1)), F.lit(True), "left")
    score = F.coalesce(V.cosine(F.col("vector"), F.col("__query")), F.lit(-1.0))
    upcoming = F.col("position") > F.col("__now")
    by_score = Window.partitionBy("queue_id", upcoming).orderBy(F.desc("score"), "position")
    rows = rows.withColumn("score", score).withColumn("__rank", F.row_number().over(by_score))
    near = upcoming & (F.col("__rank") <= k)
    part = F.when(~upcoming, 0).when(near, 1).otherwise(2)
    place = F.struct(part, F.when(near, F.col("__rank").cast("long")).otherwise(F.col("position")))
    order = Window.partitionBy("queue_id").orderBy("__place")
    return rows.withColumn("__place", place).select("queue_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "song_id")


def top_k(pairs: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """The best k of each query, with their rank."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "song_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(tracks: DataFrame, queries: DataFrame, k: int, most: int = 16_384) -> DataFrame:
    """(query_id, song_id, score, rank): k nearest of each query by product, itself left out, in blocks of matrix products.

    queries (query_id, vector) is a stated set. Up to most of them are broadcast as one matrix, and tracks stay where they
    are. More of them are dealt by a hash to blocks of about most, as tracks are, and each pair of blocks is a
    task. Either way a task keeps its own best k of each query, and those are merged.
    """
    n = queries.count()
    if n <= most:
        return _nearest(tracks, queries, k)
    blocks, others = -(-n // most), max(1, -(-tracks.count() // most))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vector", deal("query_id", blocks).alias("i"), every(others).alias("j"))
    held = tracks.select(F.lit(False).alias("asks"), F.col("song_id").alias("id"), "vector", every(blocks).alias("i"), deal("song_id", others).alias("j"))

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table["asks"].to_numpy(), table["id"].to_numpy()
        x = np.stack(table["vector"].to_numpy(zero_copy_only=False)).astype(np.float64)
        parts = [*_best(ids[asks], x[asks], ids[~asks], x[~asks], k)] if asks.any() and not asks.all() else []
        return pa.Table.from_batches(parts, pa.schema([("query_id", pa.int64()), ("song_id", pa.int64()), ("score", pa.float64())]))

    return top_k(asked.unionByName(held).groupBy("i", "j").applyInArrow(run, NEAREST), k)


NEAREST = "query_id bigint, song_id bigint, score double"


def _best(ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, block: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of a block's tracks for each query; of those that tie at the k-th place all, as the merge goes by id."""
    for at in range(0, len(ids), 1024):
        score = matrix[at : at + 1024] @ block.T
        score[ids[at : at + 1024, None] == own[None, :]] = -np.inf
        n = min(k, score.shape[1])
        least = np.partition(score, -n, axis=1)[:, -n][:, None]
        q, s = np.nonzero((score >= least) & np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(own[s]), pa.array(score[q, s])], ["query_id", "song_id", "score"])


def _nearest(tracks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query_id", "vector").orderBy("query_id").collect()
    ids = np.asarray([r["query_id"] for r in rows], dtype=np.int64)
    matrix = np.asarray([r["vector"] for r in rows], dtype=np.float64)
    shared = tracks.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                yield from _best(ids, matrix, np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1), k)

    return top_k(tracks.select("song_id", "vector").mapInArrow(run, NEAREST), k)


def close_pairs(tracks: DataFrame, most: float, rows_per_block: int = 2048, rows: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b and 1 - product at most most: a theta self-join.

    By a pivot index where that multiplies less than products of all blocks; both find the same pairs, and shuffle and store a row once.
    """
    n = tracks.count() if rows is None else rows
    index = PivotIndex(tracks, most, n, rows_per_block)
    return index.pairs() if index.copies < n * max(1, -(-n // rows_per_block)) else block_pairs(tracks, most, n, rows_per_block)


def block_pairs(tracks: DataFrame, most: float, n: int, rows_per_block: int = 2048) -> DataFrame:
    """close_pairs() as products of all blocks with all: blocks of one cell."""
    count = block_count(n, rows_per_block, STORED_ROWS)
    own = F.pmod(F.xxhash64("song_id"), F.lit(count)).cast("int")
    return Blocks(np.zeros(1, dtype=int), np.full(1, count - 1), np.eye(1, dtype=bool)).pairs(tracks.select(own.alias("own"), F.lit(0).alias("cell"), "song_id", "vector"), most)


#: Rows of a stored block, at most.
STORED_ROWS = 8192


class Blocks:
    """Rows (own, cell, song_id, vector) dealt to blocks, stored once as one row for each block, and the close pairs among them.

    A cell's rows are in the blocks from begin to end, and open, cell by cell, has the cells whose rows meet, each cell's own among them. The
    stored table is multiplied with itself, without a shuffle: a task reads files of it, and multiplies two blocks at a time. So disk is two
    copies of the rows, however many the blocks are; what is read of them grows with the square.
    """

    def __init__(self, begin: np.ndarray, end: np.ndarray, opened: np.ndarray) -> None:
        self.begin, self.end, self.open, self.count = begin, end, opened, int(end.max()) + 1

    def stored(self, rows: DataFrame) -> DataFrame:
        """(own, near, song_id, cell, vector): a block's rows by ascending id, as bytes, and the blocks that it meets."""
        begin, end, opened, numbers = self.begin, self.end, self.open | self.open.T, np.arange(self.count, dtype=np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = [batch for batch in batches if batch.num_rows]
            if not some:
                return
            at = joined(iter(some), ["own", "cell", "song_id", "vector"])
            order = np.lexsort((at["song_id"], at["own"]))
            for of in np.split(order, np.flatnonzero(np.diff(at["own"][order])) + 1):
                met = opened[np.unique(at["cell"][of])].any(0)
                near = numbers[((begin[met, None] <= numbers) & (numbers <= end[met, None])).any(0)]
                held = [pa.array([at[c][of].tobytes()], pa.binary()) for c in ("song_id", "cell", "vector")]
                yield pa.RecordBatch.from_arrays([pa.array(at["own"][of[:1]], pa.int32()), pa.array([near], pa.list_(pa.int32())), *held], ["own", "near", "song_id", "cell", "vector"])

        return written(rows.repartitionById(self.count, "own").mapInArrow(run, "own int, near array<int>, song_id binary, cell binary, vector binary"), "blocks")

    def pairs(self, rows: DataFrame, most: float, visits: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
        """(a, b, distance) with a < b and 1 - product at most most. visits tells which cells of higher number a row meets; without it, its own alone."""
        kind, cells = np.dtype(rows.schema["vector"].dataType.elementType.simpleString().replace("float", "float32")), len(self.begin)
        blocks = self.stored(rows)
        one, other = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in ("one", "other"))
        # Two blocks meet once, and every block is about as often on either side.
        i, j = F.col("one_own"), F.col("other_own")
        meet = F.array_contains("one_near", j) & ((i == j) | ((i < j) == ((i + j) % 2 == 0)))
        met = one.hint("shuffle_replicate_nl").join(other, meet).drop("one_near", "other_near")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    own, ids, cell, x = zip(*(_block(batch, side, row, kind) for side in ("one", "other")), strict=True)
                    low, high = sorted((0, 1), key=own.__getitem__)
                    to = np.zeros((len(ids[low]), cells), dtype=bool)
                    to[np.arange(len(to)), cell[low]] = True
                    for s in range(0, len(to) if visits else 0, TILE):
                        to[s : s + TILE] |= visits(x[low][s : s + TILE], cell[low][s : s + TILE])[1]
                    yield from _close(ids[low], x[low], cell[low], to, ids[high], x[high], cell[high], own[0] == own[1], most)

        return met.mapInArrow(run, "a bigint, b bigint, distance double")


def _block(batch: pa.RecordBatch, side: str, row: int, kind: np.dtype) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    own, *held = (batch.column(batch.schema.get_field_index(f"{side}_{c}"))[row] for c in ("own", "song_id", "cell", "vector"))
    ids, cell, x = (np.frombuffer(c.as_buffer(), of) for c, of in zip(held, (np.int64, np.int32, kind), strict=True))
    return own.as_py(), ids, cell, x.reshape(len(ids), -1)


def _close(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, to: np.ndarray, others: np.ndarray, y: np.ndarray, cells: np.ndarray, same: bool, most: float) -> Iterator[pa.RecordBatch]:
    """The close pairs of two blocks, or of one with itself, both by ascending id; to: which cells of the second a row of the first meets."""
    held, count = [], 0
    for c in np.unique(cells).tolist():
        callers, hosts = np.flatnonzero(to[:, c]), np.flatnonzero(cells == c)
        for s in range(0, len(callers), TILE):
            p = callers[s : s + TILE]
            inside = same and bool((cell[p] == c).all())
            z = x[p].astype(np.float64)
            for t in range(0, len(hosts), TILE):
                q = hosts[t : t + TILE]
                # Two residents of a cell meet twice where the blocks are one.
                if inside and ids[p[0]] > others[q[-1]]:
                    continue
                k, m, d = _within(x[p], z, y[q], most)
                a, b = ids[p[k]], others[q[m]]
                keep = (a < b) | ((a > b) & ((cell[p[k]] != c) | (not same)))
                held.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[keep]))
                count += len(k)
                if count > 1 << 16:
                    yield _told(held)
                    held, count = [], 0
    yield _told(held)


#: Reference points of a pivot index, at most, and rows for each that they are chosen from.
PIVOTS, CHOSEN_FROM = 512, 8
#: What rounding may take from a bound.
SLACK = 1e-7


class PivotIndex:
    """A theta self-join that compares rows with the cells that can hold a close one.

    A row resides in the cell of the reference point at the least angle, and visits those cells of higher number that
    a bound leaves open: two vectors' angle is at least that of the one to the cell's point less the
    cell's radius, and with the cell's least and greatest length that bounds their product. The reference points
    are chosen farthest first from a hashed sample, PIVOTS * CHOSEN_FROM rows at most. Neighbouring cells share a
    block, and a large one is dealt to several; blocks that hold cells open to each other meet, and of two blocks a cell's residents are multiplied, by
    tiles, with its visitors alone. Which cells a row visits is computed where it is asked for, so a row is shuffled and stored once, without them.
    Only a row for each pair of cells goes to the driver. copies counts the rows that products of blocks of rows_per_block in each cell take, a measure
    of the work, closed the pairs of cells that no row joins; without reference points, or if most is 1 or more, when no bound helps, copies is infinite.
    """

    def __init__(self, tracks: DataFrame, most: float, n: int, rows_per_block: int = 2048) -> None:
        self.most, self.size, self.copies, self.closed = float(most), rows_per_block, float("inf"), 0
        cells = min(PIVOTS, n // rows_per_block)
        if cells < 2 or most >= 1:
            return
        # A zero vector's products are 0, so it is close to none.
        known = tracks.where(~V.is_zero(F.col("vector"))).select("song_id", "vector")
        sample = known.orderBy(F.xxhash64("song_id"), "song_id").limit(cells * CHOSEN_FROM).collect()
        if not sample:
            return
        self.pivots = farthest_first(np.asarray([r["vector"] for r in sample], dtype=np.float64), cells)
        self.cells = len(self.pivots)
        stats = self._assigned(known).groupBy("cell").agg(F.max("angle").alias("radius"), F.min("length").alias("least"), F.max("length").alias("greatest"), F.count(F.lit(1)).alias("n")).collect()
        self.radius, self.least, self.greatest, residents = (np.zeros(self.cells) for _ in range(4))
        for r in stats:
            self.radius[r["cell"]], self.least[r["cell"]], self.greatest[r["cell"]], residents[r["cell"]] = r["radius"], r["least"], r["greatest"], r["n"]
        self.known = known
        visitors, self.open = np.zeros(self.cells), np.eye(self.cells, dtype=bool)
        for r in self._visiting(known).groupBy("cell", "to").agg(F.sum("n").alias("n")).collect():
            visitors[r["to"]] += r["n"]
            self.open[r["cell"], r["to"]] = True
        blocks, guests = np.maximum(1, np.ceil(residents / rows_per_block)), np.ceil(visitors / rows_per_block)
        self.closed = self.cells * (self.cells - 1) // 2 - int(np.triu(self.open, 1).sum())
        self.copies = float((residents * (blocks + guests) + visitors * blocks).sum())
        # Cells in order fill blocks of like size.
        ends = np.cumsum(residents)
        room = max(1, -(-int(ends[-1]) // block_count(n, rows_per_block, STORED_ROWS)))
        self.begin, self.end = ((ends - residents) // room).astype(int), (np.maximum(ends - 1, ends - residents) // room).astype(int)

    def _assigned(self, known: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles, length = _angles(np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, -1), pivots)
                    yield pa.RecordBatch.from_arrays([pa.array(angles.argmin(1), pa.int32()), pa.array(angles.min(1)), pa.array(length)], ["cell", "angle", "length"])

        return known.select("vector").mapInArrow(run, "cell int, angle double, length double")

    def _bound(self) -> Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]:
        """A function of rows, and of their cells where those are known: their cells, and which cells each visits."""
        pivots, radius, least, greatest, most = self.pivots, self.radius, self.least, self.greatest, self.most

        def visits(x: np.ndarray, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            angles, length = _angles(x.astype(np.float64), pivots)
            cell = angles.argmin(1) if cell is None else cell
            cosine = np.cos(np.maximum(0.0, angles - radius - SLACK))
            product = length[:, None] * np.where(cosine >= 0, greatest, least) * cosine
            return cell, (1.0 - product <= most + SLACK) & (np.arange(len(pivots)) > cell[:, None]) & (greatest > 0)

        return visits

    def _visiting(self, known: DataFrame) -> DataFrame:
        """(cell, to, n): how many rows of a cell visit another, as each task counts them."""
        visits, cells = self._bound(), self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((cells, cells), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    cell, to = visits(np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1))
                    for c in np.unique(cell):
                        n[c] += to[cell == c].sum(0)
            cell, to = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(to, pa.int32()), pa.array(n[cell, to])], ["cell", "to", "n"])

        return known.select("vector").mapInArrow(run, "cell int, to int, n bigint")

    def sent(self) -> DataFrame:
        """(own, cell, song_id, vector): each row once, by its block."""
        begin, end, pivots = self.begin, self.end, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles, _ = _angles(np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(batch.num_rows, -1), pivots)
                    cell = angles.argmin(1)
                    own = begin[cell] + np.asarray(batch.column(0)) % (end[cell] - begin[cell] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(cell, pa.int32()), batch.column(1), batch.column(2)], ["own", "cell", "song_id", "vector"])

        rows = self.known.select(F.pmod(F.xxhash64("song_id"), F.lit(1 << 30)).alias("hashed"), "song_id", "vector")
        return rows.mapInArrow(run, f"own int, cell int, song_id bigint, vector {self.known.schema['vector'].dataType.simpleString()}")

    def pairs(self) -> DataFrame:
        return Blocks(self.begin, self.end, self.open).pairs(self.sent(), self.most, self._bound())


def _within(x: np.ndarray, z: np.ndarray, y: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs within most, and their distances in doubles; z: x in doubles.

    Of 32-bit vectors a product in 32 bits finds them first, with what its rounding may take from it: for sums in any order, terms * 2**-24 of both lengths.
    """
    if x.dtype == np.float32:
        lengths = float(np.linalg.norm(z, axis=1).max()) * float(np.linalg.norm(y.astype(np.float64), axis=1).max())
        if lengths < 1e30:
            near = x @ y.T >= np.float32(1.0 - most - 2.0**-22 * (x.shape[1] + 8) * (lengths + 1.0 + abs(most)))
            if np.count_nonzero(near) << 6 <= near.size:
                k, m = np.nonzero(near)
                d = np.empty(len(k))
                for s in range(0, len(k), TILE):
                    d[s : s + TILE] = 1.0 - np.einsum("ij,ij->i", z[k[s : s + TILE]], y[m[s : s + TILE]].astype(np.float64))
                close = d <= most
                return k[close], m[close], d[close]
    d = 1.0 - z @ y.astype(np.float64).T
    k, m = np.nonzero(d <= most)
    return k, m, d[k, m]


def _told(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    a, b, d = (np.concatenate(c) for c in zip(none, *held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "distance"])


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(x, axis=1)
    return np.arccos(np.clip(x / length[:, None] @ pivots.T, -1.0, 1.0)), length


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the directions of x, each the farthest from those before; fewer if no more differ."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < k and nearest.min() < 1 - 1e-12:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]
