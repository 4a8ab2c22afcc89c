"""Rules of quality: word statistics, and n-gram perplexity within bands of the document's language.

The model of a language is of bytes of UTF-8, so every script, case and mark counts as it stands, and of order
five, with modified Kneser-Ney smoothing. Its n-grams grow with the corpus and are dealt over tasks by the two
bytes before the last, so that each task has all that a context of two bytes or more needs, in sorted arrays
of n-gram hashes (here: the codes themselves, which 64 bits hold) with their counts and probabilities. Shorter
contexts, 65 536 pairs of bytes a language at most, and the discounts are worked out on the driver.
Bits are counted by letter, so that marks and markup, however regular, never make a text look likelier.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import in_arrow, texts

ORDER = 5
#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
#: How many spreads below and above its language's median a document's bits may lie.
LOWER, UPPER = 12.0, 8.0
#: Bytes of text for each task of the model.
DEAL = 1 << 26
_U = np.uint64
#: All bytes but the first ones of letters, which are A-Z, a-z and what is beyond ASCII.
_NO_LETTERS = bytes(k for k in range(256) if not (65 <= k <= 90 or 97 <= k <= 122 or k >= 0xC2))


def grams(own: list[str], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """language << 40 | context << 8 | byte for each byte of the texts, and where each text ends.

    The context's most significant byte is the one just before; line ends stand before a text.
    """
    parts = [x.encode("utf-8", "replace") for x in own]
    pad = ORDER - 1
    raw = np.frombuffer(b"".join(b"\n" * pad + x for x in parts), dtype=np.uint8)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    code = raw.astype(np.int64)
    for k in range(1, ORDER):
        code[k:] |= raw[:-k].astype(np.int64) << (8 * (ORDER - k))
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(pad * np.arange(1, len(own) + 1), lengths)
    return code[at] | np.repeat(lang.astype(np.int64) << (8 * ORDER), lengths), ends


def shorter(code: np.ndarray) -> np.ndarray:
    """The n-gram without the byte furthest back."""
    return ((code >> 16) << 8) | (code & 255)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4; halves where there are too few."""
    n = [0.0, *counts.tolist()]
    if not all(n[1:4]):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]], 0, [0, 1, 2, 3])


def probabilities(code: np.ndarray, count: np.ndarray, off: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Of ascending n-grams of one order, from their counts, the discounts of each one's language (rows of off) and the probability one order below."""
    if not len(code):
        return np.empty(0)
    starts = B.runs(code >> 8)
    of = np.cumsum(np.bincount(starts, minlength=len(code))) - 1
    taken = off[np.arange(len(code)), np.minimum(count, 3).astype(np.int64)]
    total = np.add.reduceat(count, starts)[of]
    return (count - taken + np.add.reduceat(taken, starts)[of] * lower) / total


@dataclass(frozen=True)
class Top:
    """Discounts by order and language; ascending (language << 16 | byte << 8 | byte) with their probabilities."""

    off: dict[int, np.ndarray]
    pair: np.ndarray
    p: np.ndarray


def top_of(pair: np.ndarray, count: np.ndarray, seen: dict[int, np.ndarray], languages: int) -> Top:
    """From the different bytes before each pair of bytes, and by order from 3 how many n-grams of each language have the counts 1 to 4."""
    off = {k: np.stack([discounts(x) for x in seen[k]]) for k in seen}
    one, ones = np.unique(((pair >> 16) << 8) | (pair & 255), return_counts=True)
    tally = lambda code, n, bits: np.stack([np.bincount(n[(code >> bits) == k].astype(np.int64), minlength=5)[1:5] for k in range(languages)])
    own = lambda t, code, bits: np.stack([discounts(x) for x in t])[code >> bits] if len(code) else np.empty((0, 4))
    p1 = probabilities(one, ones.astype(float), own(tally(one, ones, 8), one, 8), np.full(len(one), 1 / 256))
    before = p1[np.searchsorted(one, ((pair >> 16) << 8) | (pair & 255))]
    return Top(off, pair, probabilities(pair, count, own(tally(pair, count, 16), pair, 16), before))


def orders(code: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of orders 5, 4 and 3: the highest as they are, then the different bytes before each."""
    out = [(code, count)]
    for _ in range(2):
        short, n = np.unique(shorter(out[-1][0]), return_counts=True)
        out.append((short, n.astype(float)))
    return out


def low_sums(code: np.ndarray, count: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, key, n): kind 2: the different bytes before each pair of bytes; 3 to 5: by language * 4 + c - 1 the n-grams with count c up to 4."""
    found = orders(code, count)
    out = [(2, *(x.astype(np.int64) for x in np.unique(shorter(found[2][0]), return_counts=True)))]
    for k, (own, n) in enumerate(found):
        few = n <= 4
        key = (own[few] >> (8 * (ORDER - k))) * 4 + n[few].astype(np.int64) - 1
        out.append((ORDER - k, *(x.astype(np.int64) for x in np.unique(key, return_counts=True))))
    return out


def log2_of(code: np.ndarray, count: np.ndarray, top: Top) -> np.ndarray:
    """log2 of the probability of each n-gram of a task's part of the model, which ascend."""
    found = orders(code, count)
    short = shorter(found[2][0])
    p = top.p[np.searchsorted(top.pair, short)]
    for k in (2, 1, 0):
        own, n = found[k]
        if k < 2:
            p = p[np.searchsorted(found[k + 1][0], shorter(own))]
        p = probabilities(own, n, top.off[ORDER - k][own >> (8 * (ORDER - k))], p)
    return np.log2(p)


def deal_of(code: np.ndarray, deals: int) -> np.ndarray:
    """By language and the two bytes before the last."""
    prefix = (code >> (8 * (ORDER - 2))).astype(_U)
    return ((prefix * _U(0x9E3779B97F4A7C15)) >> _U(33)).astype(np.int64) % deals


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract fixes them."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    spaces = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeated_lines = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        repeated_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for k, w in enumerate(windows):
            if often[w] > 1:
                repeats += k + 3 - max(end, k)
                end = k + 3
    return len(words), len(text) - spaces, symbols, repeated_lines, repeats


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", written=lambda df, what: df) -> DataFrame:
    """id_col, the word statistics, lang ("": null), n_letters and bits a letter under the model of the document's language, learned from all documents.

    docs are read twice and must give the same rows in the same tasks both times, as files do. Languages are
    the different values of lang_col, whose list is on the driver.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"), F.spark_partition_id().alias("__part"))
    found = own.groupBy("__lang").agg(F.sum(F.octet_length("__text")).alias("n")).orderBy("__lang").collect()
    names = {r["__lang"]: k for k, r in enumerate(found)}
    deals = max(8, -(-sum(r["n"] or 0 for r in found) // DEAL))
    spark = docs.sparkSession

    def codes(piece: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
        own = texts(piece.column("__text"))
        lang = np.asarray([names[x] for x in piece.column("__lang").to_pylist()], dtype=np.int64)
        return own, *grams(own, lang)

    def ask(batches):
        return B.asked(B.numbered(batches, "__text"), lambda piece: [np.unique(codes(piece)[1], return_counts=True)], lambda code: deal_of(code, deals))

    wanted = written(in_arrow(own, ask, B.ASKED), "grams")
    dealt = wanted.repartition(deals, "deal")

    def sums(batches):
        _, code, n = B.gathered(batches)
        if len(code):
            for kind, key, v in low_sums(code, n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(v)], ["kind", "key", "v"])

    got = in_arrow(dealt, sums, "kind int, key bigint, v bigint").groupBy("kind", "key").agg(F.sum("v").alias("v")).orderBy("kind", "key").toArrow()
    kind, key, v = (got[c].to_numpy() for c in ("kind", "key", "v"))
    seen = {k: np.zeros((max(1, len(names)), 4)) for k in (3, 4, 5)}
    for k, table in seen.items():
        table.reshape(-1)[key[kind == k]] = v[kind == k]
    shared = spark.sparkContext.broadcast(top_of(key[kind == 2], v[kind == 2].astype(float), seen, max(1, len(names))))

    def answer(batches):
        held, code, n = B.gathered(batches)
        if held:
            yield from B.answers(held, code, log2_of(code, n, shared.value))

    def rows_of(piece: pa.RecordBatch, gram: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        own, code, ends = codes(piece)
        rows = [statistics(x) for x in own]
        sums_ = np.concatenate(([0.0], np.cumsum(B.looked_up(code, gram, values), dtype=np.float64)))
        n = np.fromiter((len(x.encode("utf-8", "replace").translate(None, _NO_LETTERS)) for x in own), dtype=np.int64, count=len(own))
        bits = -np.diff(sums_[np.concatenate(([0], ends))]) / np.maximum(n, 1)
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        return pa.RecordBatch.from_arrays([piece.column("__id"), *columns, piece.column("__lang"), pa.array(n), pa.array(bits)], [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang", "n_letters", "bits"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, n_letters bigint, bits double"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), deals)
    return B.met(B.folded(own, "__text"), in_arrow(dealt, answer, B.ANSWERED), rows_of, schema, parts)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER, min_words: int = 50, written=lambda df, what: df) -> DataFrame:
    """id_col, the statistics, base_failed, perplexity (of a letter), and kept.

    A document fails the base rules with under min_words words or with over half of its words in repeated
    three-word windows. The bits a letter of the others have a median in each language and a spread: the
    median absolute deviation, or one over the root of the document's letters if that is more, for short
    texts vary more. A document is rejected more than lower spreads below the median or upper ones above it.
    Null text has no words and fails; null languages are a language of their own; repeated rows count as
    rows; very long texts are scored whole; an empty table gives none. written(df, name) cuts the lineage.
    """
    rows = written(scored(docs, id_col, text_col, lang_col, written), "scored")
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    usual = rows.where(~F.col("base_failed"))
    middle = usual.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10000).alias("middle"))
    # A row per language, whose list is on the driver already.
    off = usual.join(F.broadcast(middle), "lang").groupBy("lang").agg(F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), 0.5, 10000).alias("off"), F.first("middle").alias("middle"))
    judged = rows.join(F.broadcast(off.withColumnRenamed("lang", "__of")), rows["lang"] == F.col("__of"), "left")
    spread_ = F.greatest(F.col("off"), F.lit(1.0) / F.sqrt(F.greatest(F.col("n_letters"), F.lit(1))))
    within = F.col("bits").between(F.col("middle") - F.lit(lower) * spread_, F.col("middle") + F.lit(upper) * spread_)
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.pow(F.lit(2.0), "bits").alias("perplexity"), kept.alias("kept"))
