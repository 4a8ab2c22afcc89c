"""Personal data by weak supervision.

Candidates are the strict matches of four kinds, those that fail a strict rule (a card's checksum, a part of
an address beyond 255, a number of digits), and looser shapes of the same kinds. Four labelers vote on each:
the strict expression, the shape's arithmetic, a gazetteer and the context before it. Candidates with the
same votes are one pattern, so expectation-maximisation estimates from a small table of counts how reliable
each labeler is. Its posteriors label a bounded sample of candidates, which trains a logistic classifier on
votes, shapes of characters and words around; that decides on all that is not strict. Strict matches stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import arrow_map, in_arrow, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed by the contract, written so that no text makes them quadratic: an address grows leftwards from its @,
# and digits of an ip are taken whole, as a shorter run can never be followed by the dot.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser shapes. The bounds are those of the things: 64 characters before an at, 63 in a part of a domain, 2 to 5 parts, 15 digits in a phone number.
_AT = r"(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
_HIDDEN = re.compile(rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])|(?<![0-9+])00[1-9][0-9](?:[\x20-]?[0-9]){7,11}(?![0-9])")

#: Gazetteers: top-level domains, first digits of card issuers, calling codes.
_TLDS = frozenset("com org net edu gov io info biz de fr es uk us eu ch at it nl be pl se no dk ru jp cn br in ca au".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
_CODES = re.compile(r"(?:\+|00)?(?:1|33|34|39|41|43|44|49|7|81|86|91)|\(?[2-9]")
#: Words before a candidate that speak for or against it.
_FOR = (re.compile(r"mail|contact|write|reach|escri|schreib", re.I), re.compile(r"\bip\b|host|server|login|address|adres", re.I), re.compile(r"card|visa|amex|credit|tarjeta|carte|karte|pay", re.I), re.compile(r"phone|call|tel|mobil|fax|llam|anruf|contact|whatsapp", re.I))
_AGAINST = re.compile(r"version|isbn|order|invoice|serial|sku|part no|ticket|build|release", re.I)
#: Code points of context before a candidate.
CONTEXT = 40
LABELERS, VOTES = 4, 3
#: Hashed features of a candidate; candidates of each kind that the classifier learns from, at most.
FEATURES, SAMPLE = 1 << 10, 2048
_SHAPE = str.maketrans({**dict.fromkeys(map(chr, range(48, 58)), "0"), **dict.fromkeys(map(chr, range(65, 91)), "A"), **dict.fromkeys(map(chr, range(97, 123)), "a")})
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _short(digits: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def strict_spans(text: str) -> tuple[list[S.Span], list[S.Span]]:
    """The strict matches, leftmost and not overlapping within a kind; and those that fail a rule, which are not retried.

    What fails is a candidate only if it could still be personal data: dotted numbers of 15 characters at most, the
    longest that an address can be; cards of 12 to 19 digits (under 64 characters, as one separator at most stands between two);
    phones of 7 or 8 digits, as short local numbers have, since none has fewer or over 15.
    """
    out: list[S.Span] = []
    failed: list[S.Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL_SET:
                start -= 1
        if m and start < at:
            out.append((start, EMAIL, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        into = out if all(map(_short, m.group().split("."))) else failed
        if into is out or m.end() - m.start() <= 15:
            into.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() < 64:
            d = _digits(m.group())
            if 12 <= len(d) <= 19:
                (out if luhn(d) else failed).append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        n = len(_digits(m.group()))
        if 9 <= n <= 15:
            out.append((m.start(), PHONE, m.end()))
        elif 7 <= n < 9:
            failed.append((m.start(), PHONE, m.end()))
    return out, failed


def loose_spans(text: str, base: list[S.Span], failed: list[S.Span]) -> list[S.Span]:
    """The other candidates that touch no strict match and not each other: looser shapes first, then what failed."""
    found: list[S.Span] = []
    low = text.lower()
    if " dot " in low or "dot)" in low or "dot]" in low:
        found += [(m.start(), EMAIL, m.end()) for m in _HIDDEN.finditer(text)]
    if text.count(":") >= 7:
        found += [(m.start(), IP, m.end()) for m in _IP6.finditer(text)]
    found += [(m.start(), CARD, m.end()) for m in _DOTTED_CARD.finditer(text)]
    found += [(m.start(), PHONE, m.end()) for m in _NATIONAL.finditer(text)]
    out: list[S.Span] = []
    for more in (found, failed):
        taken = sorted((a, b) for a, _, b in [*base, *out])
        k, end = 0, 0
        for s in sorted(more):
            while k < len(taken) and taken[k][1] <= s[0]:
                k += 1
            if s[0] >= end and (k == len(taken) or taken[k][0] >= s[2]):
                out.append(s)
                end = s[2]
    return sorted(out)


def votes(text: str, span: S.Span, strict: bool) -> list[int]:
    """The labelers' votes: 0 abstains, 1 for, 2 against."""
    start, kind, end = span
    own = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    digits = _digits(own)
    if kind == EMAIL:
        tail = re.split(r"[^A-Za-z]+", own.rstrip(")] "))[-1].lower()
        shape, gazetteer = (1 if 2 <= len(tail) <= 6 else 2), (1 if tail in _TLDS else 2)
    elif kind == IP:
        shape = 1 if ":" in own or all(map(_short, own.split("."))) else 2
        gazetteer = 2 if own.startswith(("0.", "0:0:0:0:")) else 1
    elif kind == CARD:
        shape, gazetteer = (1 if luhn(digits) else 2), (1 if _ISSUERS.match(digits) else 2)
    else:
        shape, gazetteer = (1 if 9 <= len(digits) <= 15 else 2), (1 if _CODES.match(own) else 2)
    context = 2 if _AGAINST.search(before) else 1 if _FOR[kind].search(before) else 0
    return [1 if strict else 0, shape, gazetteer, context]


def features(text: str, span: S.Span, ballot: list[int]) -> list[int]:
    """Hashed: the kind, the votes but the strict expression's, three-character shapes, and the words around."""
    start, kind, end = span
    own = f"^{text[start:end].translate(_SHAPE)}$"
    before = _LETTERS.findall(text[max(0, start - CONTEXT) : start].lower())[-2:]
    after = _LETTERS.findall(text[end : end + CONTEXT].lower())[:1]
    names = {f"kind {kind}", *(f"vote {kind} {k} {v}" for k, v in enumerate(ballot[1:])), *(f"shape {kind} {own[k : k + 3]}" for k in range(len(own) - 2))}
    names |= {f"before {kind} {w}" for w in before} | {f"after {kind} {w}" for w in after}
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names})


def expectation_maximisation(ballots: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The probability that each row of ballots (patterns by labelers) is personal data.

    Labelers err independently given the truth; an abstention is an outcome like the others. The first
    guess is the majority, and each outcome has one imagined vote, so rare patterns can't be certain.
    """
    n = len(ballots)
    p = np.clip(0.5 + 0.2 * ((ballots == 1).sum(1) - (ballots == 2).sum(1)), 0.1, 0.9)
    for _ in range(rounds):
        logs = np.zeros((n, 2))
        for side, weight in enumerate((counts * (1 - p), counts * p)):
            logs[:, side] += np.log(weight.sum() + 1)
            for k in range(ballots.shape[1]):
                theta = np.bincount(ballots[:, k], weights=weight, minlength=VOTES) + 1
                logs[:, side] += np.log(theta / theta.sum())[ballots[:, k]]
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
    return p


def train(rows: list[list[int]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression of the targets on sets of features, by scaled gradient steps."""
    w, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    if not rows:
        return w
    sizes = np.asarray([len(r) for r in rows])
    flat, row = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[flat], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(flat, weights=off[row], minlength=FEATURES) + 0.01 * w
        squares += grad * grad
        w -= 0.5 * grad / np.sqrt(squares)
    return w


def probability(w: np.ndarray, own: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[own].sum(), -30, 30))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, strict and loose spans (start, kind, end in flat arrays), and seen: for each, strict first, (kind and votes as a number, features)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        strict, loose, seen = [], [], []
        for text in texts(batch.column(1)):
            base, failed = strict_spans(text)
            base.sort()
            more = loose_spans(text, base, failed)
            strict.append([x for s in base for x in s])
            loose.append([x for s in more for x in s])
            own = []
            for s, is_strict in [*((s, True) for s in base), *((s, False) for s in more)]:
                ballot = votes(text, s, is_strict)
                own.append({"code": s[1] + 4 * sum(v * VOTES**k for k, v in enumerate(ballot)), "features": features(text, s, ballot)})
            seen.append(own)
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(strict, kind), pa.array(loose, kind), pa.array(seen, pa.list_(pa.struct([("code", pa.int32()), ("features", pa.list_(pa.int32()))])))], [id_col, "strict", "loose", "seen"]
        )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, strict array<bigint>, loose array<bigint>, seen array<struct<code:int,features:array<int>>>"
    return arrow_map(docs.select(id_col, text_col), run, schema, text_col)


def classifier(found: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """The weights learned from all votes and from at most sample candidates of each kind, one of the least hash in as many buckets.

    The votes are counted over all candidates: at most 4 * 3**4 patterns reach the driver.
    """
    each = found.select(F.col(id_col).alias("__id"), F.posexplode("seen").alias("__at", "__seen")).select("__id", "__at", "__seen.code", "__seen.features")
    rows = each.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    if not rows:
        return np.zeros(FEATURES)
    code = np.asarray([r["code"] for r in rows])
    counts = np.asarray([r["n"] for r in rows], dtype=float)
    ballots = np.stack([code // 4 // VOTES**k % VOTES for k in range(LABELERS)], axis=1)
    posterior = np.zeros(len(code))
    for kind in range(len(KINDS)):
        own = code % 4 == kind
        if own.any():
            posterior[own] = expectation_maximisation(ballots[own], counts[own])
    h = F.xxhash64("__id", "__at", "code")
    chosen = each.groupBy(F.col("code") % 4, F.pmod(h, F.lit(sample))).agg(F.min(F.struct(h.alias("h"), "code", "features")).alias("one")).select("one.*").orderBy("h", "code", "features").collect()
    of = dict(zip(code.tolist(), posterior.tolist(), strict=True))
    return train([r["features"] for r in chosen], np.asarray([of[r["code"]] for r in chosen]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, written=lambda df, what: df) -> DataFrame:
    """id_col, n_<kind> and base_sha256 of the strict spans, spans of those and of the accepted others, and n_added of these.

    Null text is empty; a text without personal data has an empty list and its digest, and so do all of a
    table without candidates; an empty table gives none. Very long texts and runs of digits are read whole.
    Added spans touch no strict one. Repeated rows count as rows. written(df, name) cuts the lineage after
    the texts are read, so that they are read once.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    w = classifier(found, id_col)

    def run(batches):
        for batch in batches:
            strict, loose, seen = (batch.column(k).to_pylist() for k in (1, 2, 3))
            triples = lambda r: [tuple(r[i : i + 3]) for i in range(0, len(r), 3)]
            base = [triples(r) for r in strict]
            more = [[s for s, x in zip(triples(r), own[len(b) :], strict=True) if probability(w, x["features"]) >= threshold] for r, b, own in zip(loose, base, seen, strict=True)]
            counts = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([S.digest(S.line(r, KINDS)) for r in base], pa.string())
            joined = pa.array([S.line(a + b, KINDS) for a, b in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, joined, pa.array([len(x) for x in more], pa.int64())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + "".join(f"n_{k} bigint, " for k in KINDS) + "base_sha256 string, spans string, n_added bigint"
    return in_arrow(found, run, schema)
