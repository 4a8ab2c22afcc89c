"""Minimum spanning forests of a table of weighted edges, and the components that they fall into when cut.

One forest answers for every threshold: two nodes are joined by edges of at most a weight if and only if the
forest's edges of at most that weight join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import narrow, written
from .graph import connected_components

#: Edges that one task takes up: rounds over the cluster go on until no more are left.
MOST = 1 << 21
EDGES = "a bigint, b bigint, w double"


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 the least one that each is joined to."""
    f = np.arange(n)
    while True:
        x, y = f[u], f[v]
        apart = x != y
        if not apart.any():
            return f
        np.minimum.at(f, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (f[f] != f).any():
            f = f[f]


def kept(u: np.ndarray, v: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges are the minimum spanning forest of u and v; equal weights go by a, then b."""
    if not len(u):
        return np.empty(0, np.int64)
    order = np.lexsort((b, a, w))
    nodes, ends = np.unique(np.concatenate((u[order], v[order])), return_inverse=True)
    x, y = ends[: len(order)], ends[len(order) :]
    label, chosen, alive = np.arange(len(nodes)), [], np.arange(len(order))
    while True:
        p, q = label[x[alive]], label[y[alive]]
        alive, p, q = alive[p != q], p[p != q], q[p != q]
        if not len(alive):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.empty(0, np.int64)
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, p, alive)
        np.minimum.at(first, q, alive)
        best = np.unique(first[first < len(order)])
        chosen.append(best)
        label = least_labels(label[x[best]], label[y[best]], len(nodes))[label]


#: Edges beside those of its forest that a task collects, and the shares of the forest at whose weights it knows the components.
COLLECTED, LEVELS = 1 << 18, (0.25, 0.5, 0.75, 0.9, 0.97, 1.0)


class Running:
    """The minimum spanning forest of a task's nodes out of tiles of weights up to most, in memory that grows with the nodes.

    An edge is passed over if the forest of those before joins its ends by lighter ones.
    """

    def __init__(self, ids: np.ndarray, most: float) -> None:
        self.ids, self.most = ids, most
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new: list[list[np.ndarray]] = []
        self.count, self.levels = 0, []

    def add(self, rows: np.ndarray, columns: np.ndarray, w: np.ndarray) -> None:
        near = w <= self.most
        if self.levels:
            # On a part of the tile, the level that leaves the fewest edges.
            left = lambda level, p, q, w: (w <= level[0]) | (level[1][p][:, None] != level[1][q][None, :])
            p, q, some = rows[::16], columns[::16], w[::16, ::16]
            near &= left(min(self.levels, key=lambda level: np.count_nonzero(left(level, p, q, some) & (some <= self.most))), rows, columns, w)
        p, q = np.nonzero(near & (w < np.inf))
        u, v, w = rows[p], columns[q], w[p, q]
        for most, label in self.levels:
            keep = (w <= most) | (label[u] != label[v])
            u, v, w = u[keep], v[keep], w[keep]
        keep = self.ids[u] != self.ids[v]
        self.new.append([u[keep], v[keep], w[keep]])
        self.count += int(keep.sum())
        if self.count > max(COLLECTED, len(self.held[0])):
            self._thin()

    def _thin(self) -> None:
        u, v, w = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        a, b = self.ids[u], self.ids[v]
        k = kept(u, v, w, np.minimum(a, b), np.maximum(a, b))
        self.held, self.new, self.count = [u[k], v[k], w[k]], [], 0
        if len(k):
            ranked = np.sort(self.held[2])
            at = sorted({float(ranked[int(q * (len(k) - 1))]) for q in LEVELS})
            self.levels = [(t, least_labels(self.held[0][self.held[2] <= t], self.held[1][self.held[2] <= t], len(self.ids)).astype(np.int32)) for t in at]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, w) of the forest, a the smaller id."""
        self._thin()
        a, b = self.ids[self.held[0]], self.ids[self.held[1]]
        return np.minimum(a, b), np.maximum(a, b), self.held[2]


def _thinned(edges: DataFrame) -> DataFrame:
    """Each task's edges without those that its own forest has no use for: no cycle's largest edge is in the forest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for batch in batches:
            new = [np.asarray(c) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            n += batch.num_rows
            if n > MOST:
                k = kept(held[3], held[4], held[2], held[0], held[1])
                held, n = [x[k] for x in held], 0
        if held is not None and len(held[0]):
            k = kept(held[3], held[4], held[2], held[0], held[1])
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in held], ["a", "b", "w", "u", "v"])

    return edges.select("a", "b", "w", "u", "v").mapInArrow(run, f"{EDGES}, u bigint, v bigint")


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of Borůvka: the lightest edge of each node u, and the edges between the components that these make."""
    ways = edges.unionByName(edges.select("a", "b", "w", F.col("v").alias("u"), F.col("u").alias("v")))
    best = written(ways.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("e")).select("u", "e.*"), "best")
    # Equal weights are told apart, so the lightest edges form trees, with one pair in each that points at one another.
    ahead = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
    to = best.join(ahead, "v").select(F.col("u").alias("node"), F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root"))
    while True:
        to = written(narrow(to), "roots")
        step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = to.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        moved = written(narrow(moved), "moved")
        to = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            break
    named = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))
    apart = edges.join(named("u"), "u").join(named("v"), "v").where(F.col("u2") != F.col("v2"))
    apart = apart.select("a", "b", "w", F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
    # Of the edges between two components only the lightest can be in the forest.
    apart = apart.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "u", "v")
    return best.select("a", "b", "w").distinct(), apart


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning forest of edges (a, b, w) with a < b; among equal weights those of smaller a, then b.

    Tasks thin out their own edges first: what is left grows with nodes and tasks, not with edges. Rounds of
    Borůvka over the cluster halve the nodes at least; when few enough edges are left for one task, it ends the work.
    """
    now = written(_thinned(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    found = []
    while now.count() > MOST:
        lightest, apart = _round(now)
        found.append(written(lightest, "forest"))
        now = written(_thinned(apart), "edges")
    out = written(_thinned(now.coalesce(1)).select("a", "b", "w"), "forest")
    for more in found:
        out = out.unionByName(more)
    return out


def cut_components(edges: DataFrame, keys: list[str], steps: int = 64) -> DataFrame:
    """(keys, step, node, component) of a forest's edges (keys, a, b, low, high), each there from step low up to before high; component is the least node.

    Nodes are 0 or more, below 2**57, and of one set of keys each. Where the largest forest fits a task, each set of keys and step is one; else all steps'
    components are found at once, as those of pairs of a node and a step.
    """
    at = edges.where(F.col("low") < F.col("high")).withColumn("step", F.explode(F.sequence("low", F.col("high") - 1)))
    most = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST:
        node = lambda c: F.col(c) * steps + F.col("step")
        found = connected_components(at.select(node("a").alias("a"), node("b").alias("b")))
        split = found.select(F.floor(F.col("node") / steps).alias("node"), F.floor(F.col("component") / steps).alias("component"), (F.col("node") % steps).cast("int").alias("step"))
        of = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
        return split.join(of, "node").select(*keys, "step", "node", "component")

    def run(table: pa.Table) -> pa.Table:
        nodes, ends = np.unique(np.concatenate((table["a"].to_numpy(), table["b"].to_numpy())), return_inverse=True)
        label = nodes[least_labels(ends[: table.num_rows], ends[table.num_rows :], len(nodes))]
        one = table.slice(0, 1).select([*keys, "step"]).take(pa.array(np.zeros(len(nodes), dtype=np.int64)))
        return one.append_column("node", pa.array(nodes)).append_column("component", pa.array(label))

    kinds = ", ".join(f"{k} {at.schema[k].dataType.simpleString()}" for k in keys)
    return at.select(*keys, "step", "a", "b").groupBy(*keys, "step").applyInArrow(run, f"{kinds}, step int, node bigint, component bigint")
