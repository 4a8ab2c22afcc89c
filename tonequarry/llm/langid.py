"""Language by cross-parsing entropy.

A suffix automaton of a language's sample text recognises exactly its substrings. Read greedily, a text falls
into phrases, each the longest match that the automaton has for what follows (one symbol where nothing
matches). Few phrases for its length mean little cross entropy: c phrases over n symbols against a sample
of m symbols give c * log2(m) / n bits a symbol, and the language with the least wins. Symbols are the bytes
of UTF-8, lower-cased, with white space as one blank, so that no script needs a larger alphabet.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, bounded, release, remainder, texts

#: Bounds of the training sample: per language, documents and code points of each; and bytes in all, taken evenly from these.
SAMPLE_DOCS, DOC_CHARS, SYMBOLS = 96, 400, 16384
#: A text is parsed in pieces of so many symbols, each beginning a new phrase.
PIECE = 2048
#: Letters, and some numbers that are told apart one by one.
_WORDLY = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Languages:
    """By language: its name, its sample's length, its number of each byte (0: not in the sample), how many numbers
    there are, and its parsing table: next state * 2, plus 1 where a phrase ended."""

    names: list[str]
    lengths: list[int]
    codes: list[np.ndarray]
    widths: list[int]
    tables: list[np.ndarray]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state of the smallest automaton of all substrings; state 0 starts."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return nexts


def parsing_table(nexts: list[dict[int, int]], width: int) -> np.ndarray:
    """Flat table [state * width + symbol]: where no transition is, a phrase ends and the symbol begins the next."""
    table = np.empty((len(nexts), width), dtype=np.int32)
    first = np.zeros(width, dtype=np.int32)
    for c, to in nexts[0].items():
        first[c] = to
    table[:] = first * 2 + 1
    for s, own in enumerate(nexts[1:], 1):
        for c, to in own.items():
            table[s, c] = to * 2
    return table.ravel()


def plain(text: str) -> bytes:
    """Lower-cased, runs of white space as a blank, none at the ends, in UTF-8."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most SAMPLE_DOCS texts of each language, from the middle, DOC_CHARS code points of each.

    The sample is of the least hash in each of SAMPLE_DOCS buckets of a language, found on hashes alone
    and pre-aggregated by task; only then are texts read. Of the rows with one hash the least text stands.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = known.groupBy(F.col(lang_col).alias("__lang"), F.pmod(h, F.lit(SAMPLE_DOCS)).alias("__bucket")).agg(F.min(h).alias("__h"))
    wanted = [r[0] for r in chosen.select("__h").distinct().collect()]
    start = F.greatest(F.lit(1), F.floor((F.length(text_col) - DOC_CHARS) / 2).cast("int") + 1)
    found = known.where(h.isin(wanted)).select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), start, F.lit(DOC_CHARS)).alias("text"), h.alias("h"))
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def even_sample(own: list[bytes], most: int = SYMBOLS) -> bytes:
    """At most that many bytes, as many of each text as all have, and what short ones leave by the others."""
    left, quota = most, {}
    for k in sorted(range(len(own)), key=lambda k: len(own[k])):
        quota[k] = min(len(own[k]), max(0, left // (len(own) - len(quota)) - 1))
        left -= quota[k] + 1
    return b" ".join(own[k][: quota[k]] for k in range(len(own)))


def learn(rows: list[tuple[str, str]]) -> Languages:
    """rows: (language, text) of the sample."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in sorted(rows):
        by_lang.setdefault(lang, []).append(plain(text))
    out = Languages(sorted(by_lang), [], [], [], [])
    for name in out.names:
        got = np.frombuffer(even_sample(by_lang[name]), dtype=np.uint8)
        seen = np.unique(got)
        code = np.zeros(256, dtype=np.uint8)
        code[seen] = np.arange(1, len(seen) + 1)
        out.lengths.append(len(got))
        out.codes.append(code)
        out.widths.append(len(seen) + 1)
        out.tables.append(parsing_table(suffix_automaton(code[got]), len(seen) + 1))
    return out


def lettered(text: str) -> bool:
    """Whether a letter (category L) is in the text."""
    return any(m.group().isalpha() for m in _WORDLY.finditer(text))


def phrases(symbols: np.ndarray, ends: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """The number of phrases of each piece; pieces lie one after the other in symbols and end at ends.

    All pieces step through the automaton together, the longest first, so that those still going on are
    always the front of the arrays.
    """
    starts = np.concatenate(([0], ends[:-1]))
    order = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[order]
    at = starts[order].copy()
    state = np.zeros(len(order), dtype=np.int64)
    # The start state counts a phrase with the first symbol.
    count = np.zeros(len(order), dtype=np.int32)
    # alive[t]: pieces longer than t.
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for n in alive.tolist():
        code = table[state[:n] + symbols[at[:n]]]
        count[:n] += code & 1
        state[:n] = code >> 1
        state[:n] *= width
        at[:n] += 1
    out = np.empty_like(count)
    out[order] = count
    return out


def predict(own: list[str], model: Languages) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not model.names or not own:
        return ["und"] * len(own), np.zeros(len(own))
    has = np.fromiter(map(lettered, own), dtype=bool, count=len(own))
    folded = [plain(x) for x in own]
    sizes = np.fromiter(map(len, folded), dtype=np.int64, count=len(own))
    raw = np.frombuffer(b"".join(folded), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    pieces = np.maximum(1, -(-sizes // PIECE))
    firsts = np.concatenate(([0], np.cumsum(pieces)))
    of = np.repeat(np.arange(len(sizes)), pieces)
    rank = np.arange(len(of)) - firsts[of]
    ends = np.minimum(bounds[of] + (rank + 1) * PIECE, bounds[of + 1])
    each = zip(model.tables, model.codes, model.widths, model.lengths, strict=True)
    bits = np.stack([np.add.reduceat(phrases(c[raw], ends, t, w), firsts[:-1]) * math.log2(max(m, 2)) for t, c, w, m in each])
    order = np.argsort(bits, axis=0, kind="stable")
    best = np.take_along_axis(bits, order[:1], 0)[0]
    second = np.take_along_axis(bits, order[1:2], 0)[0] if len(model.names) > 1 else best * 0 + np.inf
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(np.isinf(second), 1.0, second / np.maximum(best + second, 1))
    return [model.names[k] if ok else "und" for k, ok in zip(order[0].tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """docs with __held_out, __lang and __score.

    Learns from the bounded sample above of the rows with a language whose crc32(id) modulo folds is not 0;
    a prediction sees the text alone. Null texts and those without a letter are `und` with score 0, as are
    all texts where nothing can be learned. Equal texts get equal answers; between equal languages the
    lesser name wins. Very long texts are parsed whole, in pieces; an empty table gives an empty one. Only
    texts go to the Python workers, and only answers come back. The three names must be free.
    """
    training = docs.where(remainder(folds, id_col) != 0)
    model = learn([(r["lang"], r["text"]) for r in sample(training, id_col, text_col, lang_col).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded(docs.sparkSession)

    def answers(column):
        langs, scores = [], []
        own, start, size = texts(column), 0, 0
        for k, x in enumerate(own):
            size += len(x)
            if size > CHUNK or k == len(own) - 1:
                lang, score = predict(own[start : k + 1], shared.value)
                langs += lang
                scores.append(score)
                start, size = k + 1, 0
        score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), score], ["lang", "score"])

    # Not deterministic by declaration only: a filter on an answer must not be answered a second time.
    answer = F.arrow_udf(answers, "lang string, score double").asNondeterministic()
    held = (remainder(folds, id_col) == 0).alias("__held_out")
    found = docs.select("*", held, answer(F.col(text_col)).alias("__found"))
    return found.select(*docs.columns, "__held_out", F.col("__found.lang").alias("__lang"), F.col("__found.score").alias("__score"))


def keep_identified(docs: DataFrame, lang_col: str = "lang", **columns: str) -> DataFrame:
    """docs in a language, with that as lang_col; null texts and texts without a letter go."""
    found = identify(docs, lang_col=lang_col, **columns).where(F.col("__lang") != "und")
    return found.select(*[F.col("__lang").alias(c) if c == lang_col else F.col(c) for c in docs.columns])
