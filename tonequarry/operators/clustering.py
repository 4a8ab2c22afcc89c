"""Albums by density: reduction, distance quantiles, density clusters, a sweep over their scale, and splitting."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.forest import cut_components, spanning_forest
from ..plans.graph import connected_components
from ..session import written
from .blocks import TILE, block_products, forests, nearest, nearest_of

MOST_DIMENSIONS, LEAST_DIMENSIONS, VARIANCE = 12, 4, 0.6
LEAST_QUANTILE, MOST_QUANTILE, COARSE, FINE = 0.001, 0.150, 40, 24
TAKE_OVER, DEPTH, SAMPLE_PAIRS = 0.6, 2, 200_000
LEAST_SCALE, MOST_SCALE = 0.5, 1.5


def min_points(n: int) -> int:
    """Of a core's neighbourhood: the logarithm of the library's size, rounded half to even, within 4 to 12."""
    return min(12, max(4, round(math.log(max(n, 1)))))


def album_cap(n: int) -> int:
    return min(60, max(20, int(0.15 * n)))


def dimensions(eigenvalues: list[float], total: float) -> int:
    """The fewest components that explain the wanted share, within bounds; all where they never do."""
    if total <= 0:
        return min(LEAST_DIMENSIONS, len(eigenvalues))
    sums = np.cumsum(eigenvalues)
    reached = np.flatnonzero(sums >= VARIANCE * total)
    k = int(reached[0]) + 1 if len(reached) else len(eigenvalues)
    return min(max(k, LEAST_DIMENSIONS), len(eigenvalues))


#: Groups whose sums a task holds before it passes them on.
GROUPS_HELD = 64


def _axes(rows: DataFrame) -> DataFrame:
    """(grp, mean, axes): of each group's vectors the mean and the leading components, from sums that tasks pass on by group."""

    def sums(batches):
        held: dict[int, list] = {}

        def out():
            for g, (total, own, n) in held.items():
                i, j = np.triu_indices(len(own))
                k = np.arange(len(own))
                columns = np.concatenate((i, k, [-1])), np.concatenate((j, k * 0 - 1, [-1])), np.concatenate((total[i, j], own, [float(n)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), g)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], ["grp", "i", "j", "g"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            grp = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            for g in np.unique(grp).tolist():
                own = x[grp == g]
                total = held.get(g, [0.0, 0.0, 0])
                held[g] = [total[0] + own.T @ own, total[1] + own.sum(0), total[2] + len(own)]
                if len(held) > GROUPS_HELD:
                    yield from out()
        yield from out()

    def solved(table: pa.Table) -> pa.Table:
        i, j, g = (table[c].to_numpy() for c in ("i", "j", "g"))
        d = int(i.max()) + 1
        n = g[i < 0][0]
        mean = np.zeros(d)
        mean[i[(j < 0) & (i >= 0)]] = g[(j < 0) & (i >= 0)] / n
        gram = np.zeros((d, d))
        up = j >= 0
        gram[i[up], j[up]] = g[up]
        gram = np.triu(gram) + np.triu(gram, 1).T - n * np.outer(mean, mean)
        values, vectors = np.linalg.eigh(gram)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        k = dimensions(values[:MOST_DIMENSIONS].tolist(), float(values.sum()))
        return pa.table({"grp": table["grp"].slice(0, 1), "mean": pa.array([mean.tolist()]), "axes": pa.array([vectors[:, :k].T.tolist()])})

    told = rows.select("grp", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(sums, "grp bigint, i int, j int, g double")
    # As many rows a group as a matrix of one row's length has numbers.
    return told.groupBy("grp", "i", "j").agg(F.sum("g").alias("g")).groupBy("grp").applyInArrow(solved, "grp bigint, mean array<double>, axes array<array<double>>")


def reduced(rows: DataFrame) -> DataFrame:
    """(grp, node, vector) of rows (grp, node, vector): by group centred, projected to the leading components, of unit length."""
    joined = rows.join(_axes(rows), "grp").select("grp", "node", "axes", V.minus(F.col("vector"), F.col("mean")).alias("x"))
    cut = joined.select("grp", "node", F.transform("axes", lambda axis: V.dot(axis, F.col("x"))).alias("cut"))
    return cut.select("grp", "node", V.normalized(F.col("cut")).alias("vector"))


def distance_quantiles(points: DataFrame, sizes: DataFrame, n: int = COARSE, sample: int = SAMPLE_PAIRS, seed: int = 7) -> DataFrame:
    """(grp, step, eps): elements of each group's sorted pair distances, at the truncated place; all pairs, or a hashed sample of that many.

    points (grp, node, vector), where a group's nodes are first, first + 1 and so on; sizes (grp, first, n). What a task
    sorts is the sample of a group at most.
    """
    pairs = F.col("n") * (F.col("n") - 1)
    few = sizes.where((pairs <= 2 * sample) & (F.col("n") > 1)).select("grp", F.lit(math.inf).alias("most"), "n")
    all_pairs = block_products(points.join(few, "grp")).select("grp", "distance")
    # Draws with replacement of two different places.
    many = sizes.where(pairs > 2 * sample).select("grp", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sample - 1).cast("long"))).alias("id"))
    draw = lambda salt, below: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), below)
    drawn = many.select("grp", (F.col("first") + draw(1, F.col("n"))).alias("i"), (F.col("first") + F.pmod(draw(1, F.col("n")) + 1 + draw(2, F.col("n") - 1), F.col("n"))).alias("j"))
    side = lambda name, v: points.select(F.col("node").alias(name), F.col("vector").alias(v))
    sampled = drawn.join(side("i", "a"), "i").join(side("j", "b"), "j").select("grp", (1 - V.dot(F.col("a"), F.col("b"))).alias("distance"))
    quantiles = np.asarray([LEAST_QUANTILE + (MOST_QUANTILE - LEAST_QUANTILE) * k / (n - 1) for k in range(n)])

    def run(table: pa.Table) -> pa.Table:
        d = np.sort(table["distance"].to_numpy())
        return pa.table({"grp": np.full(n, table["grp"][0].as_py()), "step": pa.array(np.arange(n), pa.int32()), "eps": d[np.floor(quantiles * (len(d) - 1)).astype(np.int64)]})

    return all_pairs.unionByName(sampled).groupBy("grp").applyInArrow(run, "grp bigint, step int, eps double")


def order_statistics(rows: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(step, q, eps): for each quantile the element at trunc(q * (m - 1)) of the sorted values, without interpolation."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(k, float(q)) for k, q in enumerate(quantiles)], "step int, q double")
    ranked = in_places(rows.select(F.col(value).alias("v")), "v")
    total = ranked.agg(F.count(F.lit(1)).alias("m"))
    wanted = asked.crossJoin(F.broadcast(total)).select("step", "q", F.floor(F.col("q") * (F.col("m") - 1)).alias("place"))
    return ranked.join(F.broadcast(wanted), "place").select("step", "q", F.col("v").alias("eps"))


def in_places(rows: DataFrame, *by: str) -> DataFrame:
    """rows and place, from 0 in the order of columns.

    A sort by ranges numbers rows within its partitions; places come from a row for each partition, so no task
    sorts all, and rows are shuffled once.
    """
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__nth", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("__p", F.shiftright("__nth", 33)), "sorted")
    counts = ranged.groupBy("__p").agg(F.min("__nth").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(counts.select("__p", (before - F.col("__first")).alias("__shift"))), "__p").withColumn("place", F.col("__nth") + F.col("__shift")).drop("__p", "__nth", "__shift")


def summary(rows: DataFrame, value: str) -> DataFrame:
    """(least, p10, median, p90, most, n): elements of the sorted values at n // 10, n // 2 and n * 9 // 10, without interpolation."""
    ranked = in_places(rows.select(F.col(value).alias("v")), "v")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    at = lambda num, den: F.max(F.when(F.col("place") == F.floor(F.col("n") * num / den), F.col("v")))
    return ranked.crossJoin(F.broadcast(n)).agg(F.min("v").alias("least"), at(1, 10).alias("p10"), at(1, 2).alias("median"), at(9, 10).alias("p90"), F.max("v").alias("most"), F.count("v").alias("n"))


def gram(points: DataFrame) -> DataFrame:
    """(i, j, g) with i <= j: the Gram matrix of the centred vectors, unscaled, and its trace at (-1, -1).

    Each task multiplies its own rows and passes on the sums alone: as many numbers as the matrix has, whatever
    the number of rows. The means are taken out of the sums at the end.
    """

    def run(batches):
        total, sums, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                total, sums, n = (x.T @ x, x.sum(0), len(x)) if total is None else (total + x.T @ x, sums + x.sum(0), n + len(x))
        if total is not None:
            i, j = np.triu_indices(len(sums))
            k = np.arange(len(sums))
            columns = np.concatenate((i, k, [-1])), np.concatenate((j, k * 0 - 1, [-1])), np.concatenate((total[i, j], sums, [float(n)]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], ["i", "j", "g"])

    found = points.select(F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    # As many rows as a vector has numbers.
    means = found.where((F.col("j") < 0) & (F.col("i") >= 0)).select("i", "g")
    count = found.where(F.col("i") < 0).select(F.col("g").alias("n"))
    side = lambda c: F.broadcast(means.select(F.col("i").alias(c), F.col("g").alias(f"s{c}")))
    centred = found.where(F.col("j") >= 0).join(side("i"), "i").join(side("j"), "j").crossJoin(F.broadcast(count)).select("i", "j", (F.col("g") - F.col("si") * F.col("sj") / F.col("n")).alias("g"))
    trace = centred.where(F.col("i") == F.col("j")).agg(F.sum("g").alias("g")).select(F.lit(-1).alias("i"), F.lit(-1).alias("j"), "g")
    return centred.unionByName(trace)


def density_clusters(points: DataFrame, pairs: DataFrame, eps: float, least: int) -> DataFrame:
    """(song_id, cluster): cluster is the smallest core id of the cluster, or -1.

    pairs (a, b, distance) hold each close pair once. Cores have least points within eps, themselves
    included; they link into components; a border point joins the smallest component among its cores'.
    That is what a scan in ascending id order does.
    """
    near = pairs.where(F.col("distance") <= eps).select("a", "b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = written(both.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= least).select(F.col("a").alias("core")), "core") if least > 1 else points.select(F.col("song_id").alias("core"))
    ends = near.join(core.withColumnRenamed("core", "a"), "a", "left_semi").join(core.withColumnRenamed("core", "b"), "b", "left_semi")
    part = connected_components(ends)
    named = core.join(part.withColumnRenamed("node", "core"), "core", "left").select("core", F.coalesce("component", "core").alias("cluster"))
    border = both.join(core, F.col("a") == F.col("core"), "left_anti").join(named, F.col("b") == F.col("core")).groupBy(F.col("a").alias("song_id")).agg(F.min("cluster").alias("cluster"))
    found = named.select(F.col("core").alias("song_id"), "cluster").unionByName(border)
    return points.select("song_id").join(found, "song_id", "left").select("song_id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def coverage(clusters: DataFrame, least: int, cap: int, *keys: str) -> DataFrame:
    """(keys, covered, largest): points in clusters of a size worth an album, and the size of the largest."""
    sizes = clusters.where(F.col("cluster") >= 0).groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))
    fits = F.col("size").between(least, cap)
    return sizes.groupBy(*keys).agg(F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias("covered"), F.max("size").alias("largest"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("of"), "distance").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("of"), "distance"))


def core_distances(near: DataFrame, least: int) -> DataFrame:
    """(node, core): the distance from which on a point has least points about it, itself included. near (node, of, distance) holds each point's least - 1 nearest."""
    found = near.groupBy("node").agg(F.max("distance").alias("core"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least - 1)
    return found.select("node", F.col("core") if least > 1 else F.lit(0.0).alias("core"))


class Sweep:
    """Density clusters of groups of points at any radius, from one spanning forest.

    Two cores are in one cluster at a radius if a path of edges joins them that are no longer than it and join points
    that are cores at it: an edge counts from the largest of its length and both its ends' core distances on. So the
    minimum spanning forest by that weight, cut at the radius, is the clusters' cores. A border point joins the
    cluster of the smallest core among its cores' clusters; as it is no core, its cores are among its least - 1 nearest.
    """

    def __init__(self, points: DataFrame, pairs: DataFrame, least: int) -> None:
        """points (grp, node) and pairs (grp, a, b, distance) up to the largest radius; nodes are from 0 to 2**57."""
        self._know(points, nearest_of(_both_ways(pairs), max(1, least - 1)), least)
        side = lambda c: self.known.select(F.col("node").alias(c), F.col("core").alias(f"core_{c}"))
        both = pairs.select("a", "b", "distance").join(side("a"), "a").join(side("b"), "b")
        self._span(both.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w")))

    @classmethod
    def within(cls, points: DataFrame, least: int, rows_per_block: int = TILE) -> Sweep:
        """Of points (grp, node, vector, most, n) themselves, up to their group's most. Pairs are computed twice and never stored: for each point's nearest, then for forests."""
        self = cls.__new__(cls)
        self._know(points, nearest(points, max(1, least - 1), rows_per_block), least)
        self._span(forests(points.join(self.known, "node", "left"), rows_per_block))
        return self

    def _know(self, points: DataFrame, near: DataFrame, least: int) -> None:
        self.points = points.select("grp", "node")
        near = written(near.select("node", "of", "distance"), "near")
        known = core_distances(near, least)
        # With least of 1 every point is a core, also one that is close to none.
        self.known = written(known if least > 1 else self.points.select("node", F.lit(0.0).alias("core")), "cores")
        self.cores = self.points.join(self.known, "node")
        # What a point can be a border point by: cores nearer than those that make it one.
        links = near.join(self.known.withColumnRenamed("node", "of").withColumnRenamed("core", "own"), "of").join(self.known, "node", "left")
        links = links.select("node", "of", F.greatest("distance", "own").alias("r"), F.col("core").alias("until"))
        self.links = written(links.where(F.col("until").isNull() | (F.col("r") < F.col("until"))), "links")

    def _span(self, edges: DataFrame) -> None:
        forest = spanning_forest(edges.select("a", "b", "w"))
        self.forest = written(forest.join(self.points.withColumnRenamed("node", "a"), "a").select("grp", "a", "b", "w"), "forest")

    def at(self, grid: DataFrame) -> DataFrame:
        """(grp, step, node, cluster) at each radius of grid (grp, step, eps), whose steps are 0, 1 and so on by ascending radius; points in no cluster are left out."""
        radii = written(grid.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "eps"))), lambda x: x["eps"]).alias("radii")), "radii")

        def first(w: Column) -> Column:
            """The first step whose radius reaches w."""
            return F.size(F.filter("radii", lambda e: e < w))

        last = F.size("radii")
        parts = written(cut_components(self.forest.join(radii, "grp").select("grp", "a", "b", first(F.col("w")).alias("low"), last.alias("high")), ["grp"]), "parts")
        own = self.cores.join(radii, "grp").select("grp", "node", first(F.col("core")).alias("low"), last.alias("high")).where("low < high")
        own = own.select("grp", "node", F.explode(F.sequence("low", F.col("high") - 1)).alias("step"))
        named = written(own.join(parts.drop("grp"), ["step", "node"], "left").select("grp", "step", "node", F.coalesce("component", "node").alias("cluster")), "cores")
        border = self.links.join(self.points, "node").join(radii, "grp")
        border = border.select("node", "of", first(F.col("r")).alias("step"), F.when(F.col("until").isNull(), last).otherwise(first(F.col("until"))).alias("high")).where("step < high")
        # Cores of one cluster stay in one, so a border point needs each cluster once, from the step at which it first reaches it; the cluster's least core stands for it.
        seen = border.join(named.withColumnRenamed("node", "of"), ["step", "of"]).groupBy("node", F.col("cluster").alias("of")).agg(F.min("step").alias("low"), F.max("high").alias("high"))
        seen = seen.select("node", "of", F.explode(F.sequence("low", F.col("high") - 1)).alias("step"))
        joined = seen.join(named.withColumnRenamed("node", "of"), ["step", "of"]).groupBy("grp", "step", "node").agg(F.min("cluster").alias("cluster"))
        return named.unionByName(joined)


def _tried(sweep: Sweep, grid: DataFrame, least: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """The clusters at each step of a grid, and the grid with covered and largest."""
    found = written(sweep.at(grid), "swept")
    of = coverage(found, least, cap, "grp", "step")
    return found, written(grid.join(of, ["grp", "step"], "left").na.fill(0, ["covered", "largest"]), "covered")


def best_eps(sweep: Sweep, grid: DataFrame, sizes: DataFrame, least: int, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grp, eps, step, fine) of each group that any step covers; and the clusters at the steps of the grid and of the finer one.

    The eps that covers most, the smallest of those, refined between its neighbours on the grid. Steps after the
    first whose largest cluster takes over the group do not count.
    """
    best = lambda what: F.max(F.struct("covered", (-F.col("step")).alias("back"), "eps")).alias(what)
    clusters, coarse = _tried(sweep, grid, least, cap)
    over = coarse.join(sizes, "grp").where(F.col("largest") >= TAKE_OVER * F.col("n")).groupBy("grp").agg(F.min("step").alias("stop"))
    counted = coarse.join(over, "grp", "left").where(F.col("stop").isNull() | (F.col("step") <= F.col("stop")))
    top = counted.groupBy("grp").agg(best("top")).where(F.col("top.covered") > 0).select("grp", F.col("top.covered").alias("covered"), (-F.col("top.back")).alias("at"), F.col("top.eps").alias("own"))
    top = written(top, "top")
    span = coarse.join(top, "grp").where(F.abs(F.col("step") - F.col("at")) <= 1).groupBy("grp").agg(F.min("eps").alias("low"), F.max("eps").alias("high"))
    k = F.explode(F.sequence(F.lit(1), F.lit(FINE - 1))).alias("k")
    fine_grid = span.select("grp", "low", "high", k).select("grp", (F.col("k") - 1).alias("step"), (F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / FINE).alias("eps"))
    fine_clusters, fine = _tried(sweep, written(fine_grid, "fine"), least, cap)
    better = fine.groupBy("grp").agg(best("fine"))
    finer = F.col("fine.covered") > F.col("covered")
    chosen = top.join(better, "grp").select("grp", F.when(finer, F.col("fine.eps")).otherwise(F.col("own")).alias("eps"), F.when(finer, -F.col("fine.back")).otherwise(F.col("at")).alias("step"), finer.alias("finer"))
    return written(chosen, "chosen"), clusters, fine_clusters


def cluster_groups(rows: DataFrame, least: int, cap: int, scale: float = 1.0) -> DataFrame:
    """(song_id, cluster, size): density clusters of least points or more within each group of rows (grp, song_id, vector), all groups at once.

    Each group has its own components, distances and radius, the one that covers most in clusters of least to cap
    points, times scale. Groups of fewer than twice least points have none. cluster is the song of its smallest core.
    """
    n = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * least)
    placed = in_places(rows.join(n.select("grp"), "grp").select("grp", "song_id", "vector"), "grp", "song_id").withColumnRenamed("place", "node")
    placed = written(placed, "placed")
    sizes = written(placed.groupBy("grp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "sizes")
    points = written(reduced(placed), "reduced")
    grid = written(distance_quantiles(points, sizes), "grid")
    factor = min(MOST_SCALE, max(LEAST_SCALE, scale))
    most = grid.groupBy("grp").agg((F.max("eps") * max(1.0, factor)).alias("most")).join(sizes.select("grp", "n"), "grp")
    sweep = Sweep.within(points.join(most, "grp"), least)
    chosen, clusters, finer = best_eps(sweep, grid, sizes, least, cap)
    if scale == 1.0:
        own = chosen.select("grp", "step", "finer")
        found = clusters.join(own.where(~F.col("finer")), ["grp", "step"]).unionByName(finer.join(own.where("finer"), ["grp", "step"]))
    else:
        asked = chosen.join(most, "grp").select("grp", F.lit(0).alias("step"), F.least("most", F.col("eps") * factor).alias("eps"))
        found = sweep.at(written(asked, "asked"))
    counts = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    songs = placed.select("node", "song_id")
    out = found.select("node", "cluster").join(counts, "cluster").join(songs, "node").select("song_id", "cluster", "size")
    return out.join(songs.select(F.col("node").alias("cluster"), F.col("song_id").alias("__core")), "cluster").select("song_id", F.col("__core").alias("cluster"), "size")


def cluster_tracks(tracks: DataFrame, least: int | None = None, scale: float = 1.0, cap: int | None = None, depth: int = DEPTH) -> DataFrame:
    """(song_id, cluster): albums of least to cap tracks. Larger clusters are clustered anew on their own, depth levels down; what is still larger is dropped.

    A level takes all its oversize clusters at once, each a group of its own. scale multiplies the chosen eps at the top level
    only. Zero vectors are in no album.
    """
    rows = written(tracks.where(~V.is_zero(F.col("vector"))).select(F.lit(0).cast("long").alias("grp"), "song_id", "vector"), "rows")
    n = rows.count()
    least = least or min_points(n)
    cap = cap or album_cap(n)
    out = []
    for level in range(depth + 1):
        found = written(cluster_groups(rows, least, cap, scale if level == 0 else 1.0), "clusters")
        out.append(found.where(F.col("size") <= cap).select("song_id", "cluster"))
        large = found.where(F.col("size") > cap).select(F.col("cluster").alias("grp"), "song_id")
        if level == depth or not large.limit(1).count():
            break
        rows = written(large.join(rows.drop("grp"), "song_id").select("grp", "song_id", "vector"), "rows")
    albums = out[0]
    for more in out[1:]:
        albums = albums.unionByName(more)
    return albums
