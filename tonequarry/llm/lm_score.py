"""Scores of texts under two models of the corpus: context-tree weighting of bytes, and a unigram base.

Context-tree weighting here is of binary decisions: a byte is eight, each with its own tree of contexts, the
one to DEPTH bytes before it. A node holds its Krichevsky-Trofimov estimate and mixes it, half and half, with
the product of its children, one byte further back. Every context of the training texts is a node, so the
model grows with the corpus and is never in one place: each block of texts asks once for its different
(context, next byte), with their training counts; these are dealt by the three bytes before, so that whole
subtrees meet in a task, which sums the counts and weighs its nodes, the trees of one bit of a byte after the
other. The nodes of up to TOP bytes are weighed on the driver (256**TOP contexts at most) from the sums of
those tasks; then each task answers its blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import ascii_lower, in_arrow, remainder, texts

DEPTH = 5
#: Contexts of at most so many bytes are weighed on the driver, longer ones where their first TOP + 1 bytes are dealt to.
TOP = 2
#: Bytes of text for each task of longer contexts.
DEAL = 1 << 24
#: Nodes whose decisions are worked out at a time.
ROWS = 1024
#: Words whose counts are broadcast; the others' counts are joined.
FREQUENT = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def padded(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each after DEPTH zero bytes and before one that ends it; where its own begin; its length."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + x + b"\0" for x in own), dtype=np.uint8)
    lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
    return raw, np.cumsum(lengths + DEPTH) - lengths, lengths


def _own(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the texts' own bytes among the padded ones."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def grams(own: list[bytes]) -> np.ndarray:
    """context << 8 | byte for each byte; the context's most significant byte is the one just before."""
    raw, starts, lengths = padded(own)
    code = raw.astype(np.int64)
    for k in range(1, DEPTH + 1):
        code[k:] |= raw[:-k].astype(np.int64) << (8 + 8 * (DEPTH - k))
    return code[_own(starts, lengths)]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series eight further on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    return series - np.log(shift)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each decision (heap order, 1 to 255) of rows of byte counts."""
    zero, one = np.zeros(counts.shape), np.zeros(counts.shape)
    for b in range(8):
        halves = counts.reshape(len(counts), 1 << b, 2, -1).sum(-1)
        zero[:, 1 << b : 2 << b], one[:, 1 << b : 2 << b] = halves[:, :, 0], halves[:, :, 1]
    return zero, one


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - math.log(math.pi) - _lgamma(zero + one + 1)


@dataclass(frozen=True)
class Trees:
    """child: node * 256 + byte before, to the node one deeper or -1; logs: node * 256 + byte, to its log10 probability
    where no deeper node is known. Node 0 is the empty context."""

    child: np.ndarray
    logs: np.ndarray


def _byte_logs(p: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from that of a one at each decision."""
    byte = np.arange(256)
    logs = np.zeros(p.shape)
    for b in range(8):
        ones = p[:, (1 << b) + (byte >> (8 - b))]
        logs += np.log10(np.where((byte >> (7 - b)) & 1, ones, 1 - ones))
    return logs.astype(np.float32)


def weighted(levels: list[tuple[np.ndarray, np.ndarray]]) -> Trees:
    """All trees in one place, from the nodes (ascending contexts) and their byte counts at each depth, 0 to DEPTH."""
    sizes = [len(c) for c, _ in levels]
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    child = np.full((firsts[-1], 256), -1, dtype=np.int32)
    parents, rests = [], []
    for d, (context, counts) in enumerate(levels):
        if d < DEPTH:
            below, of = levels[d + 1]
            parent = np.searchsorted(context, below >> 8)
            rest = counts.copy()
            np.subtract.at(rest, parent, of)
            child[firsts[d] + parent, below & 255] = firsts[d + 1] + np.arange(len(below))
            parents.append(parent)
            rests.append(rest)
        else:
            rests.append(counts)
    blocks = lambda n: (slice(a, min(n, a + ROWS)) for a in range(0, n, ROWS))
    # Upwards: the share of a node's weighted probability that is its own estimate's.
    share = [np.ones((n, 256), dtype=np.float32) for n in sizes]
    value = np.empty((sizes[DEPTH], 256))
    for k in blocks(sizes[DEPTH]):
        value[k] = _log_kt(*_decisions(levels[DEPTH][1][k]))
    for d in range(DEPTH - 1, -1, -1):
        split = np.zeros((sizes[d], 256))
        np.add.at(split, parents[d], value)
        value = split
        for k in blocks(sizes[d]):
            estimate = _log_kt(*_decisions(levels[d][1][k]))
            both = np.logaddexp(estimate, split[k] + _log_kt(*_decisions(rests[d][k])))
            share[d][k] = np.exp(estimate - both)
            value[k] = both - math.log(2)
    # Downwards: the mixture over depths, and what is left for those below.
    logs = np.empty((firsts[-1], 256), dtype=np.float32)
    mixed, left = np.zeros((1, 256)), np.ones((1, 256))
    for d, (_, counts) in enumerate(levels):
        if d:
            mixed, left = mixed[parents[d - 1]], left[parents[d - 1]]
        for k in blocks(sizes[d]):
            zero, one = _decisions(counts[k])
            mixed[k] += left[k] * share[d][k] * ((one + 0.5) / (zero + one + 1))
            left[k] *= 1 - share[d][k]
            zero, one = _decisions(rests[d][k])
            logs[firsts[d] + k.start : firsts[d] + k.stop] = _byte_logs(mixed[k] + left[k] * ((one + 0.5) / (zero + one + 1)))
    return Trees(child.ravel(), logs.ravel())


def log_probabilities(own: list[bytes], trees: Trees) -> np.ndarray:
    """log10 of the probability of each text and its end."""
    raw, starts, lengths = padded(own)
    at = _own(starts, lengths)
    node = np.zeros(len(at), dtype=np.int32)
    live = np.arange(len(at))
    for k in range(1, DEPTH + 1):
        deeper = trees.child[(node[live].astype(np.int64) << 8) + raw[at[live] - k]]
        live, deeper = live[deeper >= 0], deeper[deeper >= 0]
        node[live] = deeper
    logs = trees.logs[(node.astype(np.int64) << 8) + raw[at]]
    sums = np.concatenate(([0.0], np.cumsum(logs, dtype=np.float64)))
    return np.diff(sums[np.concatenate(([0], np.cumsum(lengths)))])


def _folded(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "replace").translate(_LOWER) for x in texts(column)]


@dataclass
class Decisions:
    """The nodes of one depth for one bit of a byte, by ascending key (context << 8 | heap index of the decision)."""

    key: np.ndarray
    zero: np.ndarray
    one: np.ndarray
    share: np.ndarray | float = 1.0
    mixed: np.ndarray | float = 0.0
    left: np.ndarray | float = 1.0


Levels = dict[int, tuple[np.ndarray, np.ndarray]]


def _shorter(key: np.ndarray) -> np.ndarray:
    """The key without the byte furthest back."""
    return ((key >> 16) << 8) | (key & 255)


def _heap(gram: np.ndarray, b: int) -> np.ndarray:
    return (gram & ~255) | (1 << b) | ((gram & 255) >> (8 - b))


def levels(gram: np.ndarray, n: np.ndarray, top: int, bottom: int) -> Levels:
    """By depth, the ascending (context << 8 | byte) and their counts, from those with contexts of bottom bytes."""
    out = {bottom: (gram, n)}
    for d in range(bottom - 1, top - 1, -1):
        out[d] = B.summed(_shorter(out[d + 1][0]), out[d + 1][1])
    return out


def decisions(by: Levels, b: int) -> dict[int, Decisions]:
    """By depth, the decisions on bit b."""
    out = {}
    for d, (gram, n) in by.items():
        # The keys ascend as the grams do.
        key = _heap(gram, b)
        starts = B.runs(key)
        total = lambda x, s=starts: np.add.reduceat(x, s) if len(s) else np.empty(0)
        one = total(n * ((gram >> (7 - b)) & 1))
        out[d] = Decisions(key[starts], total(n) - one, one)
    return out


def upwards(trees: dict[int, Decisions], below: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sets the shares, given the keys and log weighted probabilities below the deepest; returns those for the depth above."""
    for d in sorted(trees, reverse=True):
        t = trees[d]
        value = _log_kt(t.zero, t.one)
        if below is not None:
            key, v = below
            both = np.logaddexp(value, np.bincount(np.searchsorted(t.key, key), weights=v, minlength=len(t.key)))
            t.share, value = np.exp(value - both), both - math.log(2)
        below = B.summed(_shorter(t.key), value) if d else (t.key, value)
    return below


def downwards(trees: dict[int, Decisions], above: Decisions | None = None) -> None:
    """Sets the mixture over depths, and what is left for those below."""
    for d in sorted(trees):
        t = trees[d]
        mixed, left = np.zeros(len(t.key)), np.ones(len(t.key))
        if above is not None:
            at = np.searchsorted(above.key, _shorter(t.key))
            mixed, left = above.mixed[at], above.left[at]
        t.mixed, t.left = mixed + left * t.share * ((t.one + 0.5) / (t.zero + t.one + 1)), left * (1 - t.share)
        above = t


def bit_logs(gram: np.ndarray, trees: dict[int, Decisions], b: int) -> np.ndarray:
    """log10 of the probability of bit b of each byte after its context; where no deeper node has the decision, those left say a half."""
    p = np.full(len(gram), 0.5)
    open_ = np.arange(len(gram))
    for d in range(DEPTH, -1, -1):
        t = trees[d]
        if not len(t.key) or not len(open_):
            continue
        g = gram[open_]
        key = _heap(((g >> (8 * (DEPTH - d + 1))) << 8) | (g & 255), b)
        at = np.minimum(np.searchsorted(t.key, key), len(t.key) - 1)
        have = t.key[at] == key
        p[open_[have]] = t.mixed[at[have]] + 0.5 * t.left[at[have]]
        open_ = open_[~have]
    return np.log10(np.where((gram >> (7 - b)) & 1, p, 1 - p))


def asked(blocks: DataFrame, deals: int) -> DataFrame:
    """The different grams of each block of (__held, __text_of), and their training counts."""

    def of(piece: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        own, out, found = _folded(piece.column("__text_of")), np.asarray(piece.column("__held").to_pylist(), dtype=bool), []
        for trained in (True, False):
            g, n = np.unique(grams([own[k] for k in np.flatnonzero(out != trained).tolist()]), return_counts=True)
            found.append((g, n * float(trained)))
        return found

    def deal(gram: np.ndarray) -> np.ndarray:
        prefix = (gram >> (8 * (DEPTH - TOP))).astype(np.uint64)
        return ((prefix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % deals

    return in_arrow(blocks, lambda batches: B.asked(B.unfolded_blocks(batches), of, deal), B.ASKED)


def answered(wanted: DataFrame, deals: int) -> DataFrame:
    """The log10 probabilities of the grams of the rows of asked."""

    def lower(gram: np.ndarray, n: np.ndarray) -> Levels:
        seen = n > 0
        return levels(gram[seen], n[seen], TOP + 1, DEPTH)

    def sums(batches):
        _, gram, n = B.gathered(batches)
        if (n > 0).any():
            by = lower(gram, n)
            rows = lambda kind, key, v: pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(v)], ["kind", "key", "v"])
            for b in range(8):
                yield rows(b, *upwards(decisions(by, b)))
            yield rows(8, *B.summed(((gram >> (8 * (DEPTH - TOP + 1))) << 8) | (gram & 255), n))

    dealt = wanted.repartition(deals, "deal")
    got = in_arrow(dealt, sums, "kind int, key bigint, v double").groupBy("kind", "key").agg(F.sum("v").alias("v")).orderBy("kind", "key").toArrow()
    kind, key, v = (got[c].to_numpy() for c in ("kind", "key", "v"))
    seen = (kind == 8) & (v > 0)
    upper = levels(key[seen], v[seen], 0, TOP)
    top = [decisions(upper, b) for b in range(8)]
    for b, t in enumerate(top):
        upwards(t, (key[kind == b], v[kind == b]))
        downwards(t)
    shared = wanted.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        held, gram, n = B.gathered(batches)
        if not held:
            return
        by, logs = lower(gram, n), np.zeros(len(gram))
        for b, t in enumerate(shared.value):
            trees = decisions(by, b)
            upwards(trees)
            downwards(trees, t[TOP])
            logs += bit_logs(gram, t | trees, b)
        yield from B.answers(held, gram, logs)

    return in_arrow(dealt, run, B.ANSWERED)


def _tokens(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    """A row for each word, A-Z lower-cased."""
    word = F.explode(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "[\\x20\\x09-\\x0D]+"))
    return docs.select(*keep, word.alias("__word")).where(F.col("__word") != "")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, frequent: int = FREQUENT, written=lambda df, what: df) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows with crc32(id) modulo folds equal to fold are held out; both models learn from all others. score is
    the log10 probability of the text, A-Z lower-cased, and its end under the context trees; base_score that
    of its words and end under add-one unigram counts, with one more word for the unseen. Null text is
    empty. Repeated rows are texts of their own in learning, and each gets its scores. Counts of the
    frequent words, at most that number whatever the corpus, are broadcast; those of all others are joined.
    Texts of any length are scored whole, in blocks. An empty table gives an empty one.
    """
    held = remainder(folds, id_col) == fold
    training = docs.where(~held)
    counts = written(_tokens(training, text_col).groupBy("__word").agg(F.count(F.lit(1)).alias("__c")), "counts")
    totals = counts.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    size = docs.agg(F.sum((~held).cast("long")).alias("ends"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    ends, deals = size["ends"] or 0, max(8, -(-(size["bytes"] or 0) // DEAL))
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    often = counts.orderBy(F.desc("__c"), "__word").limit(frequent)
    table = often.toArrow()
    known = {w.encode(): math.log10(c + 1) for w, c in zip(table["__word"].to_pylist(), table["__c"].to_pylist(), strict=True)}
    session = docs.sparkSession
    known = session.sparkContext.broadcast(known)
    end_log, unit = math.log10(ends + 1), math.log10(n + 1 * (v + 1))

    def rows_of(batch: pa.RecordBatch, gram: np.ndarray, by_gram: np.ndarray) -> pa.RecordBatch:
        own = _folded(batch.column("__text_of"))
        by_byte = B.looked_up(grams(own), gram, by_gram)
        bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in own])))
        logs = np.diff(np.concatenate(([0.0], np.cumsum(by_byte, dtype=np.float64)))[bounds])
        tokens, hits, base = [], [], []
        get = known.value.get
        for x in own:
            words = x.split()
            found = [c for c in map(get, words) if c is not None]
            tokens.append(len(words) + 1)
            hits.append(len(found) + (ends > 0))
            base.append(math.fsum(found) + end_log)
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__text"), long([1] * len(own)), long(tokens), long(hits), pa.array(base, pa.float64()), pa.array(logs), long(size)], names)

    names = [id_col, "__text", "__rows", "n_tokens", "n_known", "__base", "score", "__bytes"]
    kind = docs.schema[id_col].dataType.simpleString()
    # Written, so that those who ask are those who are answered.
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text_of"), held.alias("__held"), F.xxhash64(text_col).alias("__text"), F.spark_partition_id().alias("__part"))
    blocks = written(B.folded(own, "__text_of"), "blocks")
    answers = answered(written(asked(blocks, deals), "asked"), deals)
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), deals)
    scored = B.met(blocks, answers, rows_of, f"`{id_col}` {kind}, __text bigint, __rows bigint, n_tokens bigint, n_known bigint, __base double, score double, __bytes bigint", parts)
    # The other words: the frequent ones are left out before the shuffle, so no word is a large share of it.
    rare = _tokens(docs, text_col, id_col, F.xxhash64(text_col).alias("__text")).join(F.broadcast(often.select("__word")), "__word", "left_anti")
    rest = rare.join(counts, "__word").groupBy(id_col, "__text").agg(F.count(F.lit(1)).alias("n_known"), F.sum(F.log10(F.col("__c") + 1)).alias("__base"))
    nil = F.lit(0).cast("long")
    rest = rest.select(id_col, "__text", nil.alias("__rows"), nil.alias("n_tokens"), "n_known", "__base", F.lit(0.0).alias("score"), nil.alias("__bytes"))
    summed = scored.unionByName(rest).groupBy(id_col, "__text").agg(*(F.sum(c).alias(c) for c in names[2:]))
    # Equal rows were summed; each is one of them again.
    rows = summed.withColumn("__one", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))))
    each = lambda c: F.col(c) / F.col("__rows")
    return rows.select(
        id_col,
        (remainder(folds, id_col) == fold).alias("held_out"),
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (each("__base") - each("n_tokens") * F.lit(unit)).alias("base_score"),
        each("score").alias("score"),
        (-each("score") / each("__bytes") * F.lit(math.log2(10))).alias("bits_per_byte"),
    )
