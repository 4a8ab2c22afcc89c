"""Near-duplicates by fast similarity sketches, banding and verification on whole shingle sets.

A sketch has T coordinates. In round i each shingle falls into a random one and bids i plus a random
fraction; a coordinate keeps its lowest bid, and later rounds only fill coordinates that are still empty.
From round T on, round T + j sends every shingle to coordinate j, so all fill within 2 T rounds, mostly in
the first few. Coordinates agree with the probability of the sets' Jaccard similarity, and concentrate as
if they were independent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..session import narrow
from .common import arrow_map, texts

#: Coordinates in BANDS bands of ROWS. At similarity 0.85 all bands differ with probability (1 - 0.85**6)**32 = 3e-7.
ROWS, BANDS = 6, 32
T = ROWS * BANDS
#: A shingle is rare if at most so many of the documents that are still compared hold it.
RARE = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(own: list[str], words: int) -> list[np.ndarray]:
    """The ascending 64-bit hashes of each text's distinct shingles: words in a row, A-Z lower-cased.

    A text of fewer words is one shingle, and one without words has none.
    """
    known: dict[bytes, int] = {}
    out = []
    factors = [_U(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(words)]
    for text in own:
        parts = text.encode("utf-8", "replace").translate(_LOWER).split()
        for w in parts:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
        n = len(h) - words + 1
        if n >= 1:
            s = np.zeros(n, dtype=np.uint64)
            for k, f in enumerate(factors):
                s += _mixed(h[k : k + n] * f)
            out.append(np.unique(_mixed(s)))
        elif len(h):
            out.append(np.asarray([xxhash.xxh3_64_intdigest(b" ".join(parts))], dtype=np.uint64))
        else:
            out.append(h)
        if len(known) > 1 << 20:
            known.clear()
    return out


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; all ones for the empty set."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, ~_U(0), dtype=np.uint64)
    for i in range(2 * t):
        if not len(x):
            break
        h = _mixed(x + _U(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        bid = (h & _U(0xFFFFFFFF)) | _U(i << 32)
        bin_ = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + bin_, bid)
        if i >= t or i < 8 or i % 16 == 0:
            open_ = (out.reshape(-1, t) == ~_U(0)).any(1)
            if not open_[row].all():
                stay = open_[row]
                x, row = x[stay], row[stay]
    return out.reshape(-1, t)


def band_keys(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    wide = found.reshape(len(found), -1, rows)
    key = np.broadcast_to(np.arange(wide.shape[1], dtype=np.uint64), wide.shape[:2]).copy()
    for k in range(rows):
        key = _mixed(key * _U(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the shingle set, n_shingles, band keys)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch.column(1)), words)
        keys = band_keys(sketches(sets))
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), bands], ["id", "digest", "n", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"id {kind}, digest binary, n bigint, bands array<bigint>", text_col)


def set_table(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str, repeated: DataFrame | None = None) -> DataFrame:
    """(id, shingle hashes) of the documents in ids, a row for each; of the rows with an id in repeated, the least set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.view(np.int64) for s in shingle_sets(texts(batch.column(1)), words)]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["id", "set"])

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    of = lambda rows: arrow_map(rows, run, f"id {kind}, set array<bigint>", "text")
    if repeated is None:
        return of(wanted)
    once = of(wanted.join(repeated, "id", "left_anti"))
    return once.unionByName(of(wanted.join(repeated, "id", "left_semi")).groupBy("id").agg(F.min("set").alias("set")))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """What sizes allow: the larger set can't be beyond the smaller by more than the similarity."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _possible(n: Column, common: Column, m: Column, other: Column, shared: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can reach the similarity if they share no more than shared besides their common ones."""
    most = F.least(common, other) + shared
    return F.lit(100) * most >= F.lit(percent) * (n + m - most)


def unresolved_pairs(labelled: DataFrame, sets: DataFrame, percent: int, written) -> DataFrame:
    """(a, b): every pair of different components in one bucket that can be similar.

    labelled: key, band, id, n, bands, component, main: whether the component is the one with the most rows in
    the bucket. Rows of the main component are compared with those outside it alone, so a bucket costs the
    rows outside times all of its rows. Near copies of one text that are not quite near enough to each other
    would still meet in squares. Two bounds, both exact, leave few of them. Shingles that at most RARE
    of these documents hold are listed with their holders: pairs that share some are counted from that
    list, of at most RARE rows to a shingle. All other pairs share no rare shingle, so they can only share
    what is left of the smaller set without its rare ones. A pair counts in its first common band alone.
    """
    ids = labelled.select("id", "n", "component").distinct()
    shingles = sets.join(ids, "id").select("id", F.explode("set").alias("shingle"))
    seldom = written(narrow(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE), 4), "rare")
    rare = written(narrow(shingles.join(seldom, "shingle").select("id", "shingle", "df"), 4), "holders")
    common = ids.join(rare.groupBy("id").agg(F.count(F.lit(1)).alias("r")), "id", "left").select("id", "n", "component", (F.col("n") - F.coalesce("r", F.lit(0))).alias("common"))
    common = written(narrow(common), "common")
    known = labelled.join(common.select("id", "common"), "id")
    x, y = known.where(~F.col("main")).alias("x"), known.alias("y")
    other = F.col("y.main") | (F.col("x.component") < F.col("y.component"))
    first = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = x.band + 1")
    nothing = F.lit(0)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & other & _alike(F.col("x.n"), F.col("y.n"), percent) & _possible(F.col("x.n"), F.col("x.common"), F.col("y.n"), F.col("y.common"), nothing, percent) & first)
    apart = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    held = rare.where(F.col("df") > 1).join(common, "id")
    v, w = held.alias("v"), held.alias("w")
    both = v.join(w, (F.col("v.shingle") == F.col("w.shingle")) & (F.col("v.component") < F.col("w.component")) & _alike(F.col("v.n"), F.col("w.n"), percent))
    counted = both.groupBy(F.col("v.id").alias("p"), F.col("w.id").alias("q")).agg(F.count(F.lit(1)).alias("shared"), *(F.first(f"{k}.{c}").alias(f"{k}_{c}") for k in "vw" for c in ("n", "common")))
    near = counted.where(_possible(F.col("v_n"), F.col("v_common"), F.col("w_n"), F.col("w_common"), F.col("shared"), percent)).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return apart.unionByName(near).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least percent of their union."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return joined.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", written=lambda df, what: df) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row.

    Documents are linked if their sets of shingles share at least percent of their union; component_id is
    the smallest id reachable by links, and the document with that id is kept. Texts without words, null
    included, are linked with nothing. Ids should be unique; rows that repeat one get the component of the
    id, and a row with a null id is a component of its own with a null component_id, and kept. Ids are
    integers. Texts of any length are taken whole, and an empty table gives an empty one. Columns whose names
    begin with two underscores belong to the operator.

    1. Documents of equal sets are a class, represented by its smallest id; only representatives go on.
    2. Representatives meet in the buckets of 32 bands. A bucket with many members does not emit its
       pairs: each representative is verified against one leader, the most central member of its buckets,
       and components of those links are taken.
    3. Pairs that share a bucket and are still in different components are verified too, unless sizes or
       rare shingles rule a link out, so no link between components that a band sees is lost.
    """
    signs = written(signed(docs, words, id_col, text_col), "signs")
    real = signs.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(narrow(real.groupBy("digest").agg(F.min("id").alias("rep"))), "classes")
    reps = written(narrow(real.join(classes, "digest").where(F.col("id") == F.col("rep")).select("id", "n", "bands"), 4), "reps")
    banded = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") < F.col("high"))
    members = written(narrow(banded.join(written(narrow(buckets.select("key", "size"), 4), "buckets"), "key"), 4), "members")
    # A document is central if it shares many bands with many others, as the common source of near copies does.
    central = members.groupBy("id").agg(F.sum("size").alias("weight"))
    ranked = members.select("key", "id").join(central, "id").select("key", "id", F.struct("weight", (-F.col("id")).alias("low")).alias("place"))
    tops = written(narrow(ranked.groupBy("key").agg(F.max("place").alias("top"))), "tops")
    led = ranked.join(tops, "key").where(F.col("place") != F.col("top")).groupBy(F.col("id").alias("b")).agg(F.max("top").alias("top")).select((-F.col("top.low")).alias("a"), "b")
    # Ids repeat in no proper table; where they do, those rows alone are grouped.
    twice = written(narrow(members.select("id").distinct().join(real.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1), "id").select("id")), "twice")
    sets = written(set_table(docs, members.select("id").distinct(), words, id_col, text_col, None if twice.isEmpty() else twice), "sets")
    first = written(narrow(confirmed(led, sets, percent), 4), "links")
    part = written(narrow(connected_components(first)), "part")
    labelled = members.select("key", "band", "id", "n").join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = written(narrow(labelled, 4), "parts")
    shares = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("rows", "component")).alias("most")).where(F.col("parts") > 1)
    labelled = labelled.join(mixed.select("key", F.col("most.component").alias("largest")), "key").join(reps.select("id", "bands"), "id")
    labelled = labelled.select("key", "band", "id", "n", "bands", "component", (F.col("component") == F.col("largest")).alias("main"))
    second = confirmed(unresolved_pairs(written(narrow(labelled, 4), "labelled"), sets, percent, written), sets, percent)
    # The later links join whole components: few, and a graph of their own.
    of = lambda name: part.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    between = second.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    later = connected_components(between)
    rep_of = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("near"))
    classes = rep_of.join(later.withColumnRenamed("node", "near"), "near", "left").select("digest", F.coalesce("component", "near").alias("component"))
    named = signs.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("component", "id")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that another one of their component stands for."""
    gone = components(docs, id_col=id_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
