"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

Each digest of a document is added to one cell in each of three parts of a table: the cell counts it and
keeps the sums of digests and of their checks, modulo 2**64. Two tables of a size subtract cell by cell; what both
hold cancels, and cells that hold one digest alone start the peeling that lists all that differ. If peeling
stalls, the difference was too large for the table, and larger ones, of a size that both texts' digests would
fit, are made until it succeeds.
The difference and the counts give the Jaccard likeness of the two sets of digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import chunks, in_arrow

PARTS = 3
#: Cells to a part of the table that is published.
CELLS = 8
#: Words of more bytes than this are cut where their content says so, and every MOST bytes where it never does.
LONG, MOST = 32, 256
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _cut(word: bytes) -> list[bytes]:
    """A long word in pieces of eight bytes on average, each ending where a hash of its last four bytes says so: an insertion moves no cut but those beside it.

    Text of one repeated pattern has cuts nowhere or everywhere, so pieces without one are cut at a fixed length.
    """
    b = np.frombuffer(word, dtype=np.uint8).astype(np.uint64)
    window = b.copy()
    for k in (1, 2, 3):
        window[k:] |= b[:-k] << _U(8 * k)
    ends = [*(np.flatnonzero((_mixed(window + _U(0x9E3779B97F4A7C15)) & _U(7)) == 0) + 1).tolist(), len(word)]
    pieces, start = [], 0
    for end in ends:
        pieces += [word[k : min(end, k + MOST)] for k in range(start, end, MOST)]
        start = end
    return pieces


def digests(text: str) -> np.ndarray:
    """The ascending distinct 64-bit digests of a text's paragraphs: each word of a line with the word before it, whatever the text's length.

    The first word of a line has none before it. Words of more than LONG bytes, as text without white space is, are cut by their content. A pair that comes again has another digest each time, so
    repetitions count.
    """
    hashed = xxhash.xxh3_64_intdigest
    found, firsts = [], []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        if len(line) > LONG and words and max(map(len, words)) > LONG:
            words = [piece for w in words for piece in (_cut(w) if len(w) > LONG else (w,))]
        if words:
            firsts.append(len(found))
            found += map(hashed, words)
    own = np.asarray(found, dtype=np.uint64)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    before[firsts] = 0
    pair = np.sort(_mixed(own + _mixed(before + _U(0x9E3779B97F4A7C15))))
    new = np.ones(len(pair), dtype=bool)
    new[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(new)
    times = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    found = np.sort(_mixed(pair + times.astype(np.uint64) * _U(0xD1342543DE82EF95)))
    return found[_runs(found)]


def _runs(ascending: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(ascending), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def _checks(x: np.ndarray) -> np.ndarray:
    return _mixed(x + _U(0xD6E8FEB86659FD93)) & _U(0xFFFFFFFF)


class Tables:
    """The tables of many sets, one after the other: PARTS * cells of count, key and check for each row, whose number of cells is its own."""

    def __init__(self, x: np.ndarray, row: np.ndarray, cells: np.ndarray, seed: int) -> None:
        self.cells, self.seed = cells.astype(np.int64), seed
        self.ends = np.cumsum(PARTS * self.cells)
        n = int(self.ends[-1]) if len(cells) else 0
        self.count = np.zeros(n, dtype=np.int32)
        self.key, self.check = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.add(x, row, 1)

    def add(self, x: np.ndarray, row: np.ndarray, sign: int | np.ndarray) -> list[np.ndarray]:
        """Adds digests to their rows, or takes them out; returns the cells."""
        cells, touched = self.cells[row], []
        first = self.ends[row] - PARTS * cells
        wide = cells.astype(np.uint64)
        times = np.broadcast_to(np.asarray(sign, dtype=np.int32), x.shape)
        unsigned = times.astype(np.int64).view(np.uint64)
        key, check = x * unsigned, _checks(x) * unsigned
        for part in range(PARTS):
            h = _mixed(x ^ _U((0x9E3779B97F4A7C15 * (PARTS * self.seed + part + 1)) & 0xFFFFFFFFFFFFFFFF))
            at = first + part * cells + ((h >> _U(32)) * wide >> _U(32)).astype(np.int64)
            np.add.at(self.count, at, times)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)
            touched.append(at)
        return touched

    def minus(self, other: Tables) -> Tables:
        """The difference of two of the same sizes, cell by cell."""
        out = object.__new__(Tables)
        out.cells, out.seed, out.ends = self.cells, self.seed, self.ends
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def rows(self, chosen: np.ndarray) -> Tables:
        """Some rows of tables that are all of one size."""
        out = object.__new__(Tables)
        width = PARTS * int(self.cells[0]) if len(self.cells) else PARTS
        out.cells, out.seed = self.cells[chosen], self.seed
        out.ends = np.cumsum(PARTS * out.cells)
        out.count, out.key, out.check = (x.reshape(-1, width)[chosen].ravel() for x in (self.count, self.key, self.check))
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The digests that differ, as (row, digest, sign: 1 held by the first, -1 by the second), and by row whether these are all. Uses the tables up."""
        of = np.repeat(np.arange(len(self.cells)), PARTS * self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(of))
        # Each round takes a digest at least; a table that seems to go on forever has met a false one.
        for _ in range(64 + len(of)):
            pure = live[np.abs(self.count[live]) == 1]
            sign = self.count[pure]
            back = sign.astype(np.int64).view(np.uint64)
            key = self.key[pure] * back
            true = self.check[pure] * back == _checks(key)
            pure, key, sign = pure[true], key[true], sign[true]
            if not len(pure):
                break
            # A digest that is alone in more than one cell is taken once; cells ascend, and so do rows.
            order = np.argsort(key, kind="stable")
            row, key, sign = of[pure[order]], key[order], sign[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[new], key[new], sign[new]
            found.append((row, key, sign))
            touched = np.sort(np.concatenate(self.add(key, row, -sign)))
            live = touched[_runs(touched)]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = np.ones(len(self.cells), dtype=bool)
        whole[of[left]] = False
        row, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))
        return row, key, sign, whole

    def strings(self) -> list[str]:
        """Each row's cells: counts, keys and checks in Base64. Long sets have counts beyond a byte, so four are written."""
        width = PARTS * CELLS
        count, key, check = (x.reshape(-1, width) for x in (self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4")))
        return [base64.b64encode(a.tobytes() + b.tobytes() + c.tobytes()).decode() for a, b, c in zip(count, key, check, strict=True)]


def _flat(sets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = [sets[k] for k in rows.tolist()]
    sizes = [len(s) for s in own]
    return (np.concatenate(own) if own else np.empty(0, np.uint64)), np.repeat(np.arange(len(own)), sizes)


def published(sets: list[np.ndarray]) -> Tables:
    """The tables that fingerprints are made of."""
    return Tables(*_flat(sets, np.arange(len(sets))), np.full(len(sets), CELLS), 0)


def differences(sets: list[np.ndarray], tables: Tables, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all digests that one of a pair of rows holds alone: 1 the first, -1 the second.

    Peeled from the published tables where they suffice, else from larger ones.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = np.arange(len(pairs))
    seed, room = 0, 1.4
    while len(open_):
        a, b = pairs[open_, 0], pairs[open_, 1]
        if seed:
            # Sets differ by all they hold at most, which so many cells can tell with high probability.
            cells = ((sizes[a] + sizes[b]) * room / PARTS).astype(np.int64) + CELLS
            mine, theirs = (Tables(*_flat(sets, x), cells, seed) for x in (a, b))
            room *= 1.5
        else:
            mine, theirs = tables.rows(a), tables.rows(b)
        row, key, sign, whole = mine.minus(theirs).peeled()
        done = whole[row]
        out.append((open_[row[done]], key[done], sign[done]))
        open_ = open_[~whole]
        seed += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))


def likenesses(sets: list[np.ndarray], tables: Tables, pairs: np.ndarray) -> np.ndarray:
    """The likeness of pairs of rows: their common digests over all of theirs."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    differ = np.bincount(differences(sets, tables, pairs)[0], minlength=len(pairs))
    both = (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - differ) / 2
    union = both + differ
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def changed(text: str, version: str) -> tuple[set[int], set[int]]:
    """The digests that text holds alone, and those that its other version does, recovered by peeling."""
    sets = [digests(text), digests(version)]
    _, key, sign = differences(sets, published(sets), np.array([[0, 1]]))
    return set(key[sign > 0].tolist()), set(key[sign < 0].tolist())


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first as many code points, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(table: list[tuple], end: str | None) -> Iterator[tuple]:
    """table: (id, text) in order; end: the text that follows the last row, if it is known."""
    own = [t for _, t in table]
    following = [*own[1:], *([] if end is None else [end])]
    changed = [edited(t, f) for t, f in zip(own, following, strict=False)]
    n = len(changed)
    sets = [digests(t) for t in (*own, *([] if end is None else [end]), *changed)]
    split = len(sets) - n
    first = published(sets)
    names = first.strings()
    k = np.arange(n)
    near_edited = likenesses(sets, first, np.stack((k, k + split), axis=1))
    near_next = likenesses(sets, first, np.stack((k, k + 1), axis=1))
    for i in range(n):
        yield table[i][0], len(own[i]), hashlib.sha256(changed[i].encode("utf-8", "replace")).hexdigest(), names[i], names[split + i], near_edited[i], near_next[i]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_per_partition: int = 4) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Rows go in ascending id, null first, rows of one id in the order of their texts, and the last is
    followed by the first. Null text is empty. Empty sets are alike to each other and unlike all others.
    A document is compared with its edited text and with the next one. Texts are shuffled once, to ranges
    of ids; each range also gets a copy of the first row after it. Ids are integers. Texts of any length are
    taken whole, one at a time. Columns that are not named play no part. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, parts * ranges_per_partition)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = narrow.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 16 * ranges)).first()[0] if ranges > 1 else None
    bounds = np.unique(np.asarray(quantiles or [], dtype=np.int64))

    @F.pandas_udf(LongType())
    def range_of(ids):
        return ids.__class__(np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="left"))

    # The null id sorts before all others, in the first range.
    dealt = narrow.withColumn("range", F.when(F.col("id").isNull(), F.lit(0)).otherwise(range_of(F.coalesce("id", F.lit(0)))))
    firsts = dealt.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = [r["range"] for r in firsts]
    before = {r["range"]: order[k - 1] for k, r in enumerate(firsts)}
    # Rows with a range's first id, a row as a rule, also go to the range before it, at its end.
    heads = spark.createDataFrame([(r["range"], r["first"]["id"], before[r["range"]]) for r in firsts], f"range bigint, first {kind}, lender bigint")
    marked = dealt.join(F.broadcast(heads), "range")
    copies = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("late")), F.struct(F.col("lender").alias("to"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("late"))))
    sent = marked.select("id", "text", F.explode(copies).alias("c")).select("id", "text", F.col("c.to").alias("to"), F.col("c.late").alias("late"))
    placed = sent.repartition(parts, "to").sortWithinPartitions("to", "late", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        held: list[tuple] = []
        at = None
        closed = False
        for batch in chunks(batches, "text", 2 << 20):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out: list[tuple] = []
            for id_, text, to, late in rows:
                if to != at:
                    at, held, closed = to, [], False
                if late:
                    if not closed:
                        out += _rows(held, text)
                        held, closed = [], True
                else:
                    held.append((id_, text))
            if len(held) > 1:
                out += _rows(held[:-1], held[-1][1])
                held = held[-1:]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:5]), *(pa.array(c, pa.float64()) for c in columns[5:])],
                    [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return in_arrow(placed, run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
