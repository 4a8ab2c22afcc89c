"""A mix of sources by target weights that vary over training, on DataFrame operations alone.

Each source has a weight schedule over training time t in [0, 1]: a straight line from start to end, of mean 1.
Its integral, times the source's target number of words, is the source's cumulative demand. The inverse of
that at a document's place in the source's shuffled stream is the time at which training reads it, and the
demand of all sources together by that time is its position: the words that training has read before it.
Documents range-sort by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Fixed by the contract: weights by source in code point order, repeating.
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _source_key(c: Column) -> Column:
    """A key that is never null and sorts as the sources do, null last."""
    return F.when(c.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, weight rank) from rows (__source, __size): a row per source.

    Water-filling: with the sources in ascending order of cap over weight, those before the first whose
    cap holds at the level that the rest would share get their cap, and the rest that level by weight.
    The windows run over a row per source, not over documents.
    """
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"))
    ranked = by_source.withColumn("__rank", F.row_number().over(Window.orderBy("__source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    cap = F.col("__total") * F.lit(most)
    table = ranked.select("__source", "__total", "__rank", weight.alias("__w"), cap.alias("__cap")).withColumn("__r", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__r", "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    table = table.select(
        "*",
        F.coalesce(F.sum("__cap").over(before), F.lit(0.0)).alias("__caps_before"),
        F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__w_from"),
        (F.sum("__total").over(whole) * F.lit(share)).alias("__all"),
    )
    level = (F.col("__all") - F.col("__caps_before")) / F.col("__w_from")
    table = table.withColumn("__level", F.when(level <= F.col("__r"), level))
    table = table.withColumn("__level", F.min_by("__level", F.struct(F.col("__level").isNull(), F.col("__r"), F.col("__rank"))).over(whole))
    target = F.when(F.col("__level").isNull() | (F.col("__cap") <= F.col("__w") * F.col("__level")), F.col("__cap")).otherwise(F.col("__w") * F.col("__level"))
    return table.select("__source", F.col("__total").alias("__source_size"), F.round(target, 6).alias("__target"), "__rank")


def sized(docs: DataFrame, *keep: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns to keep, and __size, __source and __hash of each row."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(*keep, n_words(F.col(text_col)).alias("__size"), _source_key(F.col(source_col)).alias("__source"), h.alias("__hash"))


def with_places(rows: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rows_per_bucket: int = 4096) -> DataFrame:
    """rows of sized() with __source_size, __target, __rank, __even, __odd and __before: the words ahead of the row in its source's shuffled stream.

    Targets stop at most times a source's words. Null ids sort first, null sources are a source, equal rows are rows each, and an
    empty table gives an empty one.

    The stream's order is that of md5(id). One source may hold most rows, so the running sum has two
    levels: sums of buckets of the hash's range, summed over the buckets of a source, then a window
    within each bucket. Buckets hold about rows_per_bucket rows however large a source is.
    """
    narrow = rows.select("__source", "__size", "__hash")
    n = rows.select(F.count(F.lit(1))).first()[0]
    buckets = max(1, -(-n // rows_per_bucket))
    bucket = F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * buckets / 4294967296).cast("int")
    sums = narrow.withColumn("__bucket", bucket).groupBy("__source", "__bucket").agg(F.sum("__size").alias("__size"))
    in_source = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__size").over(in_source), F.lit(0)))
    # The targets come from the sums of buckets, so that texts are counted once.
    targets = source_targets(sums.select("__source", "__size"), weights, share, most)
    millionths = F.round(F.col("__target") * 1000000).cast("long")
    total = lambda odd: F.coalesce(F.sum(F.when(F.col("__rank") % 2 == odd, millionths)).over(Window.partitionBy()), F.lit(0).cast("long"))
    targets = targets.select("*", total(0).alias("__even"), total(1).alias("__odd"))
    offsets = offsets.join(targets, "__source").select("__source", "__bucket", "__offset", "__source_size", "__target", "__rank", "__even", "__odd")
    # Ties of the hash are repeated ids; size, then any equal row, decides among them.
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__bucket", bucket).withColumn("__in", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    joined = placed.join(offsets, ["__source", "__bucket"])
    return joined.withColumn("__before", F.col("__in") + F.col("__offset")).drop("__in", "__offset", "__bucket", "__source", "__hash")


def times(rank: Column) -> tuple[Column, Column]:
    """Start and end of a source's weight line: even ranks fall from 1.5 to 0.5, odd ones rise."""
    even = rank % 2 == 0
    return F.when(even, 1.5).otherwise(0.5), F.when(even, 0.5).otherwise(1.5)


def time_of(demand: Column, start: Column, end: Column) -> Column:
    """The t at which the integral of the line from start to end (mean 1) reaches the demand in [0, 1]."""
    slope = end - start
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + F.lit(2.0) * slope * demand))
    return F.when(slope == 0, demand / start).otherwise((root - start) / slope)


def words_by(t: Column) -> Column:
    """The words that all sources together have demanded by time t: the integral of their weight lines, times their targets."""
    even, odd = F.col("__even") / F.lit(1000000.0), F.col("__odd") / F.lit(1000000.0)
    return (F.lit(1.5) * even + F.lit(0.5) * odd) * t + F.lit(0.5) * (odd - even) * t * t


def position(middle: Column) -> Column:
    """The words that training has read when it comes to this word of a row's source; null beyond the target."""
    start, end = times(F.col("__rank"))
    t = time_of(middle / F.col("__target"), start, end)
    return F.when(middle < F.col("__target"), F.round(words_by(t), 3))


def reads(passes: int = 2) -> Column:
    """For each row of with_places an array of (words, position, whole): the times that training reads it.

    A source's words are read in its stream's order, then again, until its target. The document over the
    target counts with the words before it; whole says whether that is at least half of it. Rows without
    words are read once, in place, if the target is above 0.
    """
    stop = F.round(F.col("__target")).cast("long")
    found = []
    for k in range(passes):
        start = F.col("__before") + F.lit(k) * F.col("__source_size")
        words = F.least(F.col("__size"), stop - start)
        middle = start + words / 2
        read = F.struct(words.cast("long").alias("words"), position(middle).alias("position"), (2 * words >= F.col("__size")).alias("whole"))
        found.append(F.when((words > 0) | (F.lit(k == 0) & (words == 0) & (F.col("__size") == 0) & (start < stop)), read))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _passes(most: float = 2.0, **_) -> int:
    """How often a source's stream is begun until most times its words are read."""
    return max(1, math.ceil(most))


def mix(rows: DataFrame, id_col: str = "doc_id", **targets) -> DataFrame:
    """rows of sized() with __size, __source_size, __target and __reads, range-sorted by the first position; rows never read come last.

    Null texts have no words; null sources are a source, the last. Repeated rows are rows each. An empty table gives an empty one.
    """
    placed = with_places(rows, id_col, **targets).withColumn("__reads", reads(_passes(**targets)))
    return placed.orderBy(F.get("__reads", F.lit(0))["position"].asc_nulls_last(), id_col).drop("__before", "__rank", "__even", "__odd")


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """The mix itself: docs' columns and __position, a row for each copy that training reads, range-sorted by position.

    Whole documents only: that over a target is read if at least half of it lies before, so each source
    comes within half a document of it. Null text has no words and is read once, at its place, if the
    target is above 0; null sources are a source; repeated rows are documents of their own; very long texts
    are whole; an empty table gives none. Other columns pass; names that begin with __ and are named here
    must be free.
    """
    placed = with_places(sized(docs, *docs.columns, id_col=id_col, source_col=source_col, text_col=text_col), id_col, **targets)
    copies = placed.select(*docs.columns, F.explode(F.filter(reads(_passes(**targets)), lambda x: x["whole"])).alias("__read"))
    return copies.select(*docs.columns, F.col("__read.position").alias("__position")).orderBy("__position", id_col)
