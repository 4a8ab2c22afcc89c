"""Token sequences of a fixed length, as few as can be: best-fit decreasing planned over a histogram of lengths.

The plan knows how many pieces there are of each length, never which: it is as large as the histogram has
values, whatever the corpus. Each piece then takes the planned slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, in_arrow, texts

#: Bytes of text that are tokenized at a time.
PIECE = 2 << 20


class ByteIds:
    """Ids of texts by a tokenizers file.

    A byte-level BPE file whose merges make ascending ids is its own table of ranks, so its vocabulary goes to a merge
    loop that has no other work than ids. Texts that hold the string of a special token, and files of any other
    kind, go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        import public_tokenizers
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("ignore_merges"):
            return None
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # Bytes that print stand for themselves, the others for the code points from 256 on.
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
        ranks = {bytes([byte[c] for c in t]): i for t, i in vocab.items() if t not in self.special}
        if made != sorted(made) or len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=1)
def _ids(path: str) -> ByteIds:
    return ByteIds(path)


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else pieces of room ids after a first that may be shorter."""
    first = n if n <= room else n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def token_pieces(docs: DataFrame, tokenizer_path: str, room: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces, and their rank among those of their length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(room + 1, dtype=np.int64).tolist()
        tail, encode = np.asarray([end_id], dtype="<u4"), _ids(tokenizer_path).encode
        for batch in chunks(batches, "text", PIECE):
            rows, out = [], []
            for k, text in enumerate(texts(batch.column(1))):
                ids = encode(text)
                own = memoryview(np.concatenate((ids, tail)).tobytes())
                for piece, (start, length) in enumerate(cut(len(ids) + 1, room)):
                    rows.append(k)
                    out.append((piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            piece, start, length, crc, nth = zip(*out, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            at = long(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(piece, pa.int32()), long(start), long(length), long(crc), batch.column(2).take(at), long(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.spark_partition_id().alias("part"))
    return in_arrow(narrow, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


PLAN = "length bigint, first bigint, items bigint, per bigint, sequence bigint, at bigint"


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: best-fit decreasing of so many pieces of each length.

    Items first to first + items - 1 of a length go to consecutive sequences, per to each, from offset at on.
    Sequences of equal room are alike, so they are kept as ranges. A length opens at most one range of new
    sequences, and splits at most one range in two twice; a range meets a length once and then has less room: rows are
    at most in proportion to room squared, a few thousand for room 1024, however many the pieces are.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    rooms: list[int] = []  # that ranges has, ascending
    opened = 0

    def give(left: int, first: int, n: int) -> None:
        if not n or not left:
            return
        if left not in ranges:
            insort(rooms, left)
            ranges[left] = []
        ranges[left].append((first, n))

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, size = ranges[left].pop()
                if not ranges[left]:
                    del ranges[left], rooms[k]
            else:
                left, first, size = room, opened, -(-(n - done) // (room // length))
                opened += size
            # The tightest sequence stays the tightest while it takes more of the same length.
            per = left // length
            full = min(size, (n - done) // per)
            if full:
                rows.append((length, done, full * per, per, first, room - left))
                done += full * per
                give(left - per * length, first, full)
            if full < size:
                more = n - done  # less than per
                if more:
                    rows.append((length, done, more, more, first + full, room - left))
                    done += more
                    give(left - more * length, first + full, 1)
                    full += 1
                give(left, first + full, size - full)
    return rows


def pack(pieces: DataFrame, room: int, written=lambda df, what: df) -> DataFrame:
    """pieces (of token_pieces, written) with sequence_id and offset in place of part and nth.

    Pieces of room ids are sequences as they are, with negative numbers. The rest are ranked within their
    length: by task first, then in it, so no task holds a length's pieces. Only counts by length, room at
    most, go to the driver.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < room)
    counts = written(short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    found = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    slots = F.broadcast(spark.createDataFrame(found, PLAN))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select("length", F.col("part").alias("of"), "n", before.alias("before"))
    # A task's pieces of a length take one slot range after the other.
    taken = ranked.join(slots, "length").where((F.col("first") < F.col("before") + F.col("n")) & (F.col("first") + F.col("items") > F.col("before")))
    taken = taken.select(F.col("length").alias("long"), "of", (F.col("first") - F.col("before")).alias("low"), "items", "per", "sequence", "at")
    taken = written(taken, "slots")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    own = (F.col("length") == F.col("long")) & (F.col("part") == F.col("of")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("low") + F.col("items"))
    place = F.col("nth") - F.col("low")
    some = short.join(taken, own).select(*kept, (F.col("sequence") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + place % F.col("per") * F.col("length")).alias("offset"))
    whole = pieces.where(F.col("length") == room).select(*kept, (-1 - F.shiftleft(F.col("part").cast("long"), 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return some.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = 1024, end_id: int = 2, written=lambda df, what: df, **columns: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents' ids in as few sequences of room ids as best fit finds.

    A document is its ids and an end id. Null and empty texts are the end id alone; a text longer than room
    is cut into pieces of room ids, of which the first may be shorter. Repeated rows and ids, and null ids,
    are documents of their own. Columns that are not named play no part. An empty table gives an empty one.
    written(df, name) must cut the lineage, as ranks are taken from what was written.
    """
    return pack(written(token_pieces(docs, tokenizer_path, room, end_id, **columns), "pieces"), room, written)
