"""A trie of conversations by shared beginnings: partial tries per partition, merged in trees, rolled up from the bottom.

A node is the sequence of its turns, known by 128 bits: the exclusive or of hashes of each turn with its place,
so a conversation of any length is many tasks' work. Partitions sum up what they hold of each node and list
the conversations that end there; merges of these tables, keyed by the node's hash, leave one row a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

#: Turns of a conversation that a window takes at a time.
RUN = 1024
#: Rows that a task holds of its partial trie before it passes them on.
HELD = 1 << 19
#: Partial tables that meet in a merge.
FAN_IN = 64
#: Bytes of a list of ends that are held as one.
LIST = 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()

KEY = ("k1", "k2", "depth")
PARTIAL = "k1 bigint, k2 bigint, depth bigint, part bigint, seq bigint, p1 bigint, p2 bigint, size bigint, n bigint, least bigint, ends binary"


def turns(rows: DataFrame, written, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, h1, h2, size): a conversation's turns in order from place 1, as hashes of role and text, and the text's bytes.

    Equal turn numbers go by role, then by the hashes. Places come from a sort by ranges and a row for
    each partition and conversation, so no task numbers a whole conversation.
    """
    role, text = (F.coalesce(rows[c], F.lit("")) for c in (role_col, text_col))
    narrow = rows.select(
        rows[conv_col].cast("long").alias("conv"), rows[turn_col].alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(13), text, role).alias("h2"), F.octet_length(text).cast("long").alias("size"),
    )
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    by_range = written(narrow, "turns").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id())
    by_range = written(by_range.select("conv", "h1", "h2", "size", "nth", F.shiftright("nth", 33).alias("part")), "sorted")
    spans = by_range.groupBy("part", "conv").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("part", F.col("conv").alias("own"), (before - F.col("first") + 1).alias("shift"))
    joined = by_range.join(starts, (by_range["part"] == starts["part"]) & by_range["conv"].eqNullSafe(starts["own"]))
    return joined.select("conv", (F.col("nth") + F.col("shift")).alias("place"), "h1", "h2", "size")


def rebuilt(placed: DataFrame, written, block: int = 5, modulus: int = 9) -> DataFrame:
    """(conv, place, h1, h2, size) where each conversation begins with the first h turns of its block's first; place 0 stands for the conversation itself.

    h is crc32 of the id as text, modulo modulus. A block's first conversation lends at most modulus - 1 turns to
    at most 2 * block - 1 others.
    """
    h = (F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")) % modulus).cast("long")
    lengths = written(placed.groupBy("conv").agg(F.max("place").alias("length")), "lengths")
    lent = F.least(F.col("h"), F.coalesce("base_length", F.lit(0).cast("long")))
    bases = lengths.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    convs = lengths.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base")).join(bases, "base", "left")
    convs = written(convs.select("conv", "h", "base", lent.alias("lent")), "convs")
    own = convs.select(F.col("conv").alias("c"), "h", "lent")
    kept = placed.join(own, placed["conv"].eqNullSafe(own["c"]) & (F.col("place") > F.col("h"))).select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "h1", "h2", "size")
    first = placed.where((F.col("place") < modulus) & (F.col("conv") % block == 0)).select(F.col("conv").alias("base"), "place", "h1", "h2", "size")
    borrowed = convs.where(F.col("lent") > 0).join(first, "base").where(F.col("place") <= F.col("lent")).select("conv", "place", "h1", "h2", "size")
    none = F.lit(0).cast("long")
    selves = convs.select("conv", none.alias("place"), none.alias("h1"), none.alias("h2"), none.alias("size"))
    return kept.unionByName(borrowed).unionByName(selves)


def keyed(rows: DataFrame, written) -> DataFrame:
    """(k1, k2, depth, p1, p2, size, conv, last) for rows (conv, place, h1, h2, size): the node that each place stands for, its parent, and whether the conversation ends there.

    A running exclusive or in two levels: within runs of places, and over the runs of a conversation.
    """
    one = F.when(F.col("place") > 0, F.xxhash64("place", "h1", "h2")).otherwise(F.lit(0).cast("long"))
    two = F.when(F.col("place") > 0, F.xxhash64(F.lit(17), F.col("h2"), F.col("h1"), F.col("place"))).otherwise(F.lit(0).cast("long"))
    runs = rows.select("conv", "place", "size", F.floor(F.col("place") / RUN).alias("run"), one.alias("g1"), two.alias("g2"))
    w = Window.partitionBy("conv", "run").orderBy("place")
    own = written(runs.select("*", F.bit_xor("g1").over(w).alias("x1"), F.bit_xor("g2").over(w).alias("x2"), F.lead("place").over(w).isNull().alias("ends")), "runs")
    ahead = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.where(F.col("ends")).select("conv", "run", "x1", "x2")
    after = Window.partitionBy("conv").orderBy("run")
    # A row for each run of a conversation; most conversations are one.
    sums = sums.select(F.col("conv").alias("c"), F.col("run").alias("r"), F.bit_xor("x1").over(ahead).alias("b1"), F.bit_xor("x2").over(ahead).alias("b2"), F.lead("run").over(after).isNotNull().alias("more"))
    sums = written(sums.where((F.col("r") > 0) | F.col("more")), "long")
    zero = F.lit(0).cast("long")
    joined = own.join(sums, own["conv"].eqNullSafe(sums["c"]) & (F.col("run") == F.col("r")), "left")
    k1, k2 = (F.col(x).bitwiseXOR(F.coalesce(F.col(b), zero)) for x, b in (("x1", "b1"), ("x2", "b2")))
    last = F.col("ends") & ~F.coalesce(F.col("more"), F.lit(False))
    return joined.select(k1.alias("k1"), k2.alias("k2"), F.col("place").alias("depth"), k1.bitwiseXOR(F.col("g1")).alias("p1"), k2.bitwiseXOR(F.col("g2")).alias("p2"), "size", "conv", last.alias("last"))


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names]


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row has another key than the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def partial_tries(rows: DataFrame) -> DataFrame:
    """PARTIAL rows: what each partition of rows, in ascending order of conv, holds of each node.

    ends are the ids of conversations that end there, ascending, as decimals joined by commas. A partition
    passes its table on whenever it holds many rows; seq numbers these.
    """

    def combined(held: list[pa.RecordBatch], part: int, seq: int) -> pa.RecordBatch:
        names = (*KEY, "p1", "p2", "size", "conv", "last")
        k1, k2, depth, p1, p2, size, conv, last = (np.concatenate(x) for x in zip(*(_columns(b, names) for b in held), strict=True))
        order = np.lexsort((conv, depth, k2, k1))
        k1, k2, depth, p1, p2, size, conv, last = (x[order] for x in (k1, k2, depth, p1, p2, size, conv, last))
        starts = _same([k1, k2, depth])
        stops = np.append(starts[1:], len(k1))
        ends = [b""] * len(starts)
        hit = np.flatnonzero(last)
        of = np.searchsorted(starts, hit, side="right") - 1
        for at, some in zip(*_grouped(of, conv[hit]), strict=True):
            ends[at] = ",".join(map(str, some)).encode()
        long = lambda x: pa.array(x, pa.int64())
        same = np.zeros(len(starts), dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [long(x[starts]) for x in (k1, k2, depth)] + [long(same + part), long(same + seq)] + [long(x[starts]) for x in (p1, p2, size)] + [long(stops - starts), long(conv[starts]), pa.array(ends, pa.binary())],
            ["k1", "k2", "depth", "part", "seq", "p1", "p2", "size", "n", "least", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq, part = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield combined(held, part, seq)
                held, n, seq = [], 0, seq + 1
        if held:
            yield combined(held, part, seq)

    return in_arrow(rows.withColumn("part", F.spark_partition_id().cast("long")), run, PARTIAL)


def _grouped(of: np.ndarray, values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    starts = _same([of]) if len(of) else np.empty(0, np.int64)
    return of[starts].tolist(), [x.tolist() for x in np.split(values, starts[1:])] if len(of) else []


def merged(partials: DataFrame, parts: int, last: bool) -> DataFrame:
    """One merge of PARTIAL rows: those of a node whose parts divide alike by parts become one, their lists joined in the order of parts.

    A list over LIST bytes goes on as rows of its own, so no row grows with a node's conversations. The last
    merge streams them through SHA-256: ends is then the digest, in hex, and each node has one row.
    """
    group = F.floor(F.col("part") / parts)
    dealt = partials.repartition(*KEY, group).sortWithinPartitions(*KEY, "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        def row() -> tuple:
            ends = (state["sha"].hexdigest() if state["any"] else EMPTY).encode() if last else b",".join(state["ends"])
            return (*state["key"][:3], state["part"], state["seq"], *state["fixed"], state["n"], state["least"], ends)

        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, depth, part, seq, p1, p2, size, n, least = _columns(batch, ("k1", "k2", "depth", "part", "seq", "p1", "p2", "size", "n", "least"))
            ends = batch.column(batch.schema.get_field_index("ends")).to_pylist()
            starts = _same([k1, k2, depth, part // parts])
            done = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(k1)], strict=True):
                key = (int(k1[a]), int(k2[a]), int(depth[a]), int(part[a]) // parts)
                if state is None or state["key"] != key:
                    if state is not None:
                        done.append(row())
                    state = {"key": key, "part": int(part[a]), "seq": int(seq[a]), "fixed": (int(p1[a]), int(p2[a]), int(size[a])), "n": 0, "least": int(least[a]), "ends": [], "bytes": 0, "sha": hashlib.sha256(), "any": False}
                state["n"] += int(n[a:b].sum())
                state["least"] = min(state["least"], int(least[a:b].min()))
                for j in range(a, b):
                    if not ends[j]:
                        continue
                    if last:
                        state["sha"].update(b"," + ends[j] if state["any"] else ends[j])
                        state["any"] = True
                        continue
                    if state["bytes"] and state["bytes"] + len(ends[j]) > LIST:
                        done.append(row())
                        state |= {"part": int(part[j]), "seq": int(seq[j]), "n": 0, "ends": [], "bytes": 0}
                    state["ends"].append(ends[j])
                    state["bytes"] += len(ends[j])
            if done:
                yield out(done)
        if state is not None:
            yield out([row()])

    return in_arrow(dealt, run, PARTIAL)


SCHEMA = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in PARTIAL.split(", ")])


def nodes(rows: DataFrame, written) -> DataFrame:
    """(k1, k2, depth, p1, p2, size, n, least, ends): one row a node, ends the digest of its list, from rows of keyed()."""
    ranged = rows.repartitionByRange(F.col("conv").asc_nulls_first(), "depth").sortWithinPartitions(F.col("conv").asc_nulls_first(), "depth")
    now = written(partial_tries(ranged), "partials")
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    span = FAN_IN
    while span < parts:
        now = written(merged(now, span, False), "merged")
        span *= FAN_IN
    return written(merged(now, span, True).select(*KEY, "p1", "p2", "size", "n", "least", F.col("ends").cast("string").alias("ends")), "nodes")


def rolled_up(found: DataFrame, written) -> DataFrame:
    """found (of nodes()) with parent_conv, children, leaves and saved: sums over each node's subtree.

    The nodes of one least member are a chain down its conversation, and hang on a node of a smaller one. Sums
    within chains are running sums in two levels; a chain's total then travels from chain to chain upwards, summed up
    by the node that it reaches. Rounds grow with how deep branches nest in branches, not with the
    length of conversations.
    """
    up = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    linked = written(found.join(up, ["p1", "p2", "depth"], "left").select("least", "depth", "parent", "size", "n", "ends"), "linked")
    below = linked.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("least"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    own = linked.join(below, ["least", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    own = written(own.select("*", ((F.col("n") - 1) * F.col("size")).alias("saves"), F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaf")), "weighed")
    tops = own.where(F.col("parent").isNull() | (F.col("parent") != F.col("least"))).select("least", F.col("parent").alias("to"), (F.col("depth") - 1).alias("at"))
    totals = own.groupBy("least").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    chains = written(totals.join(tops, "least").select("least", "to", "at", "saves", "leaf"), "chains")
    news = chains.where(F.col("to").isNotNull()).groupBy("to", "at").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    hung = []
    where = chains.where(F.col("to").isNotNull()).select(F.col("least").alias("chain"), F.col("to").alias("to2"), F.col("at").alias("at2"))
    while True:
        news = written(news, "hung")
        if not news.limit(1).count():
            break
        hung.append(news)
        onward = news.groupBy("to").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf")).join(where, F.col("to") == F.col("chain"))
        news = onward.groupBy(F.col("to2").alias("to"), F.col("at2").alias("at")).agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    for more in hung:
        own = own.unionByName(more.select(F.col("to").alias("least"), F.col("at").alias("depth"), "saves", "leaf"), allowMissingColumns=True)
    # A node's own row and what hangs on it are summed where the node's row is the only one with ends.
    sums = own.groupBy("least", "depth").agg(*[F.max(c).alias(c) for c in ("parent", "n", "children", "ends")], F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    sums = sums.withColumn("run", F.floor(F.col("depth") / RUN))
    tail = Window.partitionBy("least", "run").orderBy(F.desc("depth"))
    sums = written(sums.select("*", F.sum("saves").over(tail).alias("s"), F.sum("leaf").over(tail).alias("l")), "tails")
    per = sums.groupBy("least", "run").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    after = Window.partitionBy("least").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    rest = per.select("least", "run", F.sum("saves").over(after).alias("more_s"), F.sum("leaf").over(after).alias("more_l")).where(F.col("more_l").isNotNull())
    joined = sums.join(written(rest, "rest"), ["least", "run"], "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("long"))
    return joined.select("least", "depth", "parent", "n", "children", add("l", "more_l").alias("leaves"), add("s", "more_s").alias("saved"), "ends")


def prefix_trie(rows: DataFrame, written=lambda df, what: df, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """One row per node of the trie of all conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows are turns; ids are integers, and a null id takes part in nothing. Turns ascend, nulls first; equal ones go by role, then by a
    hash. Null roles and texts are empty ones. A repeated row is a turn of its own. Very long
    texts are hashed whole; conversations may have any length. With rebuild, each
    begins with turns of its block's first, see rebuilt(). Columns that are not named play no part. An empty
    table gives an empty one: a trie without a member has no root. written(df, name) must cut the lineage.
    """
    placed = written(turns(rows.where(rows[conv_col].isNotNull()), written, conv_col, turn_col, role_col, text_col), "placed")
    if rebuild:
        whole = rebuilt(placed, written)
    else:
        none = F.lit(0).cast("long")
        whole = placed.unionByName(placed.select("conv").distinct().select("conv", *[none.alias(c) for c in ("place", "h1", "h2", "size")]))
    return rolled_up(nodes(keyed(whole, written), written), written).select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
