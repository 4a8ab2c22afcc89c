"""Lines that many documents share: explode, hash, count documents per hash, drop, and put the rest together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the ascending positions gone (from 0): the runs between them, so the cost is linear."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def shared_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", written=lambda df, what: df) -> DataFrame:
    """(id, gone): for each document the ascending positions of the lines that it loses.

    Lines are told apart by 128 bits of hash. A line is counted once for each distinct id that holds
    it: rows are pre-aggregated on (hash, id) before they are shuffled, so a line of every document
    costs each task one row per document that it has read. written(df, name) cuts the lineage of the
    counts, so that both sides of the join below are exchanges and Spark can split the rows of one line,
    whatever share of them it holds.
    """
    key = F.trim(F.col("__line"), F.lit(SPACES))
    exploded = docs.select(F.col(id_col).alias("__id"), F.posexplode(_lines(F.col(text_col))).alias("__pos", "__line"))
    # The length in bytes is known without a walk and never below that in code points.
    exploded = exploded.where(F.octet_length("__line") >= min_chars).select("__id", "__pos", key.alias("__line")).where(F.length("__line") >= min_chars)
    exploded = exploded.select("__id", "__pos", ascii_lower(F.col("__line")).alias("__line"))
    hashed = exploded.select("__id", "__pos", F.xxhash64("__line").alias("__h"), F.xxhash64(F.lit(7), F.col("__line")).alias("__g"))
    pairs = hashed.groupBy("__h", "__g", "__id").agg(F.lit(1).alias("__one"))
    often = pairs.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__last")).where(F.col("__n") >= min_docs)
    often = written(often.select("__h", "__g", "__last"), "often")
    hit = hashed.join(often, ["__h", "__g"]).where(F.col("__id") != F.col("__last"))
    return hit.groupBy("__id").agg(F.array_sort(F.collect_set("__pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", written=lambda df, what: df) -> DataFrame:
    """docs with text_col rewritten, and the columns __n_lines and __n_dropped before it was.

    A key is a line stripped of white space at both ends with A-Z lower-cased. Keys of min_chars code
    points or more that min_docs documents or more hold lose their lines everywhere but in the largest
    id. Null or empty text is one empty line. Rows with equal ids count as one document, each row
    keeping or losing its own lines at the positions either row lost, so give unique ids; rows with a
    null id lose nothing and count for nothing. An empty table gives an empty one. Texts of any length are
    split whole, in one row. Other columns pass, but names that begin with two underscores belong to the operator.
    """
    known = docs.where(F.col(id_col).isNotNull())
    gone = shared_lines(known, min_docs, min_chars, id_col, text_col, written).withColumnRenamed("__id", "__gone_id").withColumnRenamed("gone", "__gone")
    joined = docs.join(gone, docs[id_col] == gone["__gone_id"], "left")
    lines, lost = _lines(docs[text_col]), gone["__gone"]
    # transform() over a one-element array binds the lines once for the lambda.
    rest = F.transform(F.array(lines), lambda x: _without(x, lost))[0]
    out = F.when(lost.isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *[out.alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias("__n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("__n_dropped"),
    )
