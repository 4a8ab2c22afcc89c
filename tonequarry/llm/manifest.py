"""A Merkle manifest of a dataset: a hash tree per group of rows, one over the groups, and proofs for every row.

The trees are built by supersteps over RDDs: nodes send their digest to their parents, a parent that has heard
from all its children hashes them and sends on. Reverse supersteps hand each node's path (its siblings, level
by level, to the root) to its children, down to the rows, which are verified against it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Children of a node.
FAN = 8
#: Nodes of a partition of a superstep, about; the last hands a path to each of their children.
PER_TASK = 4_000
#: Bytes of a digest.
WIDE = 32
VERTEX = "tree bigint, place bigint, n bigint, digest binary, children array<binary>, notes array<binary>"
PATHS = "tree bigint, place bigint, head binary, path binary"
PROVEN = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the columns: each `-` if null, else its UTF-8 byte count, `:` and its text."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def placed(leaves: DataFrame, written) -> tuple[DataFrame, DataFrame]:
    """leaves (id, grp, leaf, claim) with tree, place and n; and the trees (grp, tree, n), numbered in the order of groups.

    A sort by ranges numbers the rows within its partitions; the places before each partition come from a row
    for each partition and group, so a group of any size is many tasks' work. Equal ids go by leaf, then claim.
    """
    order = [F.col(c).asc_nulls_first() for c in ("grp", "id", "leaf", "claim")]
    by_range = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id())
    by_range = written(by_range.withColumn("part", F.shiftright("nth", 33)), "leaves")
    spans = written(by_range.groupBy("part", "grp").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("rows")), "spans")
    trees = spans.groupBy("grp").agg(F.sum("rows").alias("n"))
    # As many groups as there are: numbered by ranges too.
    names = trees.repartitionByRange(F.col("grp").asc_nulls_first()).sortWithinPartitions(F.col("grp").asc_nulls_first()).withColumn("at", F.monotonically_increasing_id())
    names = written(names.withColumn("part", F.shiftright("at", 33)), "groups")
    # A row for each partition.
    ahead = names.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    ahead = ahead.select("part", "first", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    trees = written(names.join(ahead, "part").select("grp", "n", (F.col("at") - F.col("first") + F.col("before")).alias("tree")), "trees")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("part", "grp", (before - F.col("first")).alias("shift"))
    starts = starts.alias("s").join(trees.alias("t"), F.expr("s.grp <=> t.grp")).select("part", F.col("s.grp").alias("own"), "shift", "tree", "n")
    starts = written(starts, "starts")
    rows = by_range.join(starts, (by_range["part"] == starts["part"]) & by_range["grp"].eqNullSafe(starts["own"]))
    return rows.select("tree", (F.col("nth") + F.col("shift")).alias("place"), "n", "id", "leaf", "claim"), trees


def digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _completed(item: tuple) -> tuple:
    """A parent and its messages, as a vertex; it fails if a child has not been heard."""
    (tree, place), got = item
    got = sorted(got)
    n = got[0][1]
    if len(got) != min(FAN, n - place * FAN):
        raise ValueError(f"tree {tree}: {len(got)} children at {place} of {n}")
    children = [m[2] for m in got]
    return tree, place, -(-n // FAN), digest(children), children, [m[3] for m in got]


def _tasks(rows: int) -> int:
    return max(1, -(-rows // PER_TASK))


def ascend(spark: SparkSession, nodes: RDD, rows: int, most: int, written) -> list[DataFrame]:
    """The vertices of each level above nodes (tree, place, n, digest, note), of which the largest tree has most.

    A lone node of a tree has halted. A superstep is written before the next: a lost executor costs one of them.
    """
    levels: list[DataFrame] = []
    while most > 1:
        rows, most = -(-rows // FAN), -(-most // FAN)
        messages = nodes.filter(lambda v: v[2] > 1).map(lambda v: ((v[0], v[1] // FAN), (v[1] % FAN, v[2], v[3], v[4])))
        found = messages.groupByKey(_tasks(rows)).map(_completed)
        levels.append(written(spark.createDataFrame(found, VERTEX, verifySchema=False), "vertices"))
        nodes = levels[-1].select("tree", "place", "n", "digest").rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]), b""))
    return levels


def _step(children: list[bytes], k: int) -> bytes:
    """The k-th child's part of a path: its place, the number of its siblings, and them."""
    return bytes((k, len(children) - 1)) + b"".join([c for j, c in enumerate(children) if j != k])


def _forward(item: tuple) -> Iterator[tuple]:
    (tree, place), ((head, path), (children, _)) = item
    for k in range(len(children)):
        yield tree, place * FAN + k, head, _step(children, k) + path


def _arrived(item: tuple) -> Iterator[tuple]:
    _, ((head, path), (children, notes)) = item
    for k, (child, note) in enumerate(zip(children, notes, strict=True)):
        yield note, child, head, _step(children, k) + path


def descend(spark: SparkSession, levels: list[DataFrame], tops: RDD, rows: int, written) -> RDD:
    """(note, digest, head, path) of the nodes below the vertices.

    tops ((tree, 0), (height, head, path)) say of each tree how many levels it has, a head that all its nodes
    are told, and the path that its own root has.
    """
    paths = None
    for height in range(len(levels), 0, -1):
        own = tops.filter(lambda t, h=height: t[1][0] == h).map(lambda t: (t[0], t[1][1:]))
        told = own if paths is None else own.union(paths.rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), bytes(r[3])))))
        vertices = levels[height - 1].select("tree", "place", "children", "notes").rdd
        known = vertices.map(lambda r: ((r[0], r[1]), ([bytes(c) for c in r[2]], [bytes(x) for x in r[3]])))
        joined = told.join(known, _tasks(-(-rows // FAN**height)))
        if height == 1:
            return joined.flatMap(_arrived)
        paths = written(spark.createDataFrame(joined.flatMap(_forward), PATHS, verifySchema=False), "paths")
    return spark.sparkContext.emptyRDD()


def fold(own: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its path lead to, and the digest of all siblings in the path."""
    proof, at = hashlib.sha256(), 0
    while at < len(path):
        k, m = path[at], path[at + 1]
        siblings = [path[at + 2 + WIDE * j : at + 2 + WIDE * (j + 1)].hex() for j in range(m)]
        proof.update("".join(siblings).encode())
        own = hashlib.sha256("".join([*siblings[:k], own.hex(), *siblings[k:]]).encode()).digest()
        at += 2 + WIDE * m
    return own, proof.digest()


def _proven(item: tuple) -> tuple:
    note, own, head, path = item
    name, claim = pickle.loads(note)
    subroot, root = head[:WIDE], head[WIDE:]
    folded, proof = fold(claim, path)
    return name, own.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root


def prove(leaves: DataFrame, written=lambda df, what: df) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for leaves (id, grp, leaf, claim; digests in hex).

    Leaves of a group ascend by id, nulls first; rows of equal ids are leaves of their own. Runs of eight hash
    to their parent while a level has several nodes, so a lone leaf is its group's subroot; groups, null first
    and then bytewise, form the tree above. A leaf is verified if its claim and its siblings lead to the root.
    A path holds at most 7 digests for each level. An empty table gives an empty one.
    """
    spark = leaves.sparkSession
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {PROVEN}"
    rows, trees = placed(leaves.select("id", "grp", "leaf", "claim"), written)
    total = trees.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    if not total[2]:
        return spark.createDataFrame([], schema)
    nodes = rows.rdd.map(lambda r: (r[0], r[1], r[2], bytes.fromhex(r[4]), pickle.dumps((r[3], bytes.fromhex(r[5])))))
    levels = ascend(spark, nodes, total[0], total[1], written)

    # The tree over the groups: its leaves are the subroots, whose notes say their height and, of a lone leaf, its note.
    count = total[2]
    roots = nodes.filter(lambda v: v[2] == 1).map(lambda v: (0, v[0], count, v[3], pickle.dumps((v[0], 0, v[4]))))
    for height, level in enumerate(levels, 1):
        own = level.where(F.col("n") == 1).select("tree", "digest").rdd
        roots = roots.union(own.map(lambda r, h=height: (0, r[0], count, bytes(r[1]), pickle.dumps((r[0], h, b"")))))
    roots = written(spark.createDataFrame(roots, "tree bigint, place bigint, n bigint, digest binary, note binary", verifySchema=False), "subroots")
    tops = roots.rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]), bytes(r[4])))
    above = ascend(spark, tops, count, count, written)
    root = bytes((above[-1] if above else roots).select("digest").first()[0])
    if above:
        told = descend(spark, above, spark.sparkContext.parallelize([((0, 0), (len(above), root, b""))], 1), count, written)
    else:
        told = tops.map(lambda v: (v[4], v[3], root, b""))

    def subroot(item: tuple) -> tuple:
        note, own, above_it, path = item
        tree, height, lone = pickle.loads(note)
        return tree, height, lone, own, own + above_it, path

    told = written(spark.createDataFrame(told.map(subroot), "tree bigint, height int, lone binary, digest binary, head binary, path binary", verifySchema=False), "tops")
    lone = told.where(F.col("height") == 0).rdd.map(lambda r: (bytes(r[2]), bytes(r[3]), bytes(r[4]), bytes(r[5])))
    below = told.select("tree", "height", "head", "path").rdd.map(lambda r: ((r[0], 0), (r[1], bytes(r[2]), bytes(r[3]))))
    found = descend(spark, levels, below, total[0], written).union(lone)
    return spark.createDataFrame(found.map(_proven), schema, verifySchema=False)


def manifest(docs: DataFrame, claimed: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", written=lambda df, what: df) -> DataFrame:
    """prove() for the rows of docs, with id_col under its own name; claimed: the leaf that each row is now said to have.

    Nulls in any column are values of their own; empty and very long texts are hashed whole. Repeated rows are
    leaves each. Columns that are not named play no part, whatever their names. An empty table gives an empty one.
    """
    narrow = docs.select(docs[id_col].alias("id"), docs[group_col].alias("grp"), leaf(*[docs[c] for c in columns]).alias("leaf"), claimed.alias("claim"))
    return prove(written(narrow, "digests"), written).withColumnRenamed("id", id_col)
