"""Blocks of texts that ask a model which is dealt over many tasks, and meet its answers.

A model of all n-grams of a corpus grows with it and is in no one place. So each block of texts names its
different n-grams once, with their counts; these are dealt by a part of the n-gram to the tasks that hold the
model, and the answers come back to the texts, which travel compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_arrow

#: Bytes of text of a block.
BLOCK = 16 << 20
#: n-grams that a task holds of a block before it sums them up.
HELD = 1 << 21
ASKED = "block bigint, deal int, gram binary, n binary"
ANSWERED = "block bigint, gram binary, answer binary"


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending different keys and the sums of n by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = runs(key)
    return key[starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def runs(ascending: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(ascending), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def squeezed(ascending: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ascending, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def spread(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def numbered(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) in pieces of bounded size. Blocks hang on __part, spark_partition_id() where the rows are read, and their order there."""
    done = 0
    for piece in chunks(batches, name):
        first = piece.column("__part")[0].as_py() << 32
        sizes = np.asarray(pc.fill_null(pc.binary_length(piece.column(piece.schema.get_field_index(name))), 0), dtype=np.int64) + 16
        ends = done + np.cumsum(sizes)
        done, block = int(ends[-1]), (ends - sizes) // BLOCK
        cuts = (np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
            yield first + int(block[a]), piece.slice(a, b - a)


def folded(docs: DataFrame, name: str) -> DataFrame:
    """(block, rows): pieces of docs, which have __part, compressed."""

    def run(batches):
        for block, piece in numbered(batches, name):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return in_arrow(docs, run, "block bigint, rows binary")


def unfolded(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def unfolded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield block, unfolded(raw.as_py())


def asked(pieces: Iterator[tuple[int, pa.RecordBatch]], grams: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]], deal: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of ASKED: the different n-grams of each block and their counts, by deal."""

    def rows(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))
        to = deal(gram)
        order = np.argsort(to, kind="stable")
        found, first = np.unique(to[order], return_index=True)
        parts = np.split(order, first[1:])
        packed = [squeezed(gram[k]) for k in parts], [zlib.compress(n[k].astype("<u4").tobytes(), 1) for k in parts]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(found.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["block", "deal", "gram", "n"])

    at, held, size = None, [], 0
    for block, piece in pieces:
        if held and block != at:
            yield rows(at, held)
            held, size = [], 0
        at = block
        new = [x for x in grams(piece) if len(x[0])]
        held += new
        size += sum(len(g) for g, _ in new)
        if size > HELD:
            held = [summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))]
            size = 0
    if held:
        yield rows(at, held)


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """From rows of ASKED: (block, squeezed n-grams) of each; the different n-grams; their counts."""
    held, gram, n = [], np.empty(0, np.int64), np.empty(0)
    for batch in batches:
        new, counts = [gram], [n]
        for block, g, c in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            held.append((block, g))
            new.append(spread(g))
            counts.append(np.frombuffer(zlib.decompress(c), dtype="<u4").astype(np.float64))
        gram, n = summed(np.concatenate(new), np.concatenate(counts))
    return held, gram, n


def answers(held: list[tuple[int, bytes]], gram: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ANSWERED: for each row of ASKED the values of its n-grams, as 32-bit floats."""
    values = values.astype("<f4")
    for block, raw in held:
        own = values[np.searchsorted(gram, spread(raw))].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([raw], pa.binary()), pa.array([own], pa.binary())], ["block", "gram", "answer"])


def met(blocks: DataFrame, answered: DataFrame, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, parts: int) -> DataFrame:
    """fn(rows, n-grams, answers) over the rows of each block: its n-grams ascend, and hold all that it has asked for."""
    mixed = answered.select("block", "gram", "answer", F.lit(None).cast("binary").alias("rows")).unionByName(blocks.select("block", "rows"), allowMissingColumns=True)
    together = mixed.repartition(parts, "block").sortWithinPartitions("block", F.col("gram").isNull())

    def run(batches):
        at, held, table = None, [], None
        for batch in batches:
            for block, gram, answer, rows in zip(*(batch.column(k) for k in range(4)), strict=True):
                block = block.as_py()
                if block != at:
                    at, held, table = block, [], None
                if gram.is_valid:
                    held.append((gram.as_py(), answer.as_py()))
                    continue
                if table is None:
                    key = np.concatenate([spread(g) for g, _ in held]) if held else np.empty(0, np.int64)
                    value = np.concatenate([np.frombuffer(x, dtype="<f4") for _, x in held]) if held else np.empty(0, np.float32)
                    # A block that two tasks asked about has some answers twice.
                    key, first = np.unique(key, return_index=True)
                    table, held = (key, value[first]), []
                out = fn(unfolded(rows.as_py()), *table)
                if out.num_rows:
                    yield out

    return in_arrow(together, run, schema)


def looked_up(wanted: np.ndarray, gram: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted n-gram."""
    found, at = np.unique(wanted, return_inverse=True)
    place = np.minimum(np.searchsorted(gram, found), max(0, len(gram) - 1))
    if len(found) and (not len(gram) or (gram[place] != found).any()):
        raise ValueError("a block of texts has changed since it asked for its n-grams")
    return values[place][at] if len(found) else np.empty(0, values.dtype)
