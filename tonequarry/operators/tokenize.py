"""Two tokenizers for search queries, over vocabularies that are inputs: byte-level BPE and WordPiece."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

BPE_MOST, PIECE_MOST, PIECE_WORD = 77, 48, 100
#: The public pre-tokenization of byte-level BPE.
_WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else the next free one past 255."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(prints) else chr(next(spare)) for b in range(256)}


class BytePairs:
    """Lowest rank merges first, to at most BPE_MOST ids between the start and end marks."""

    def __init__(self, vocab: dict[str, int], merges: list[str], start: str = "<s>", end: str = "</s>", unknown: int = 3) -> None:
        self.vocab, self.unknown = vocab, unknown
        self.ends = vocab.get(start, 0), vocab.get(end, 2)
        pairs = [tuple(m.split(" ")) for m in merges if m.strip() and not m.startswith("#version")]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        if word not in self.known:
            parts = list(word)
            while len(parts) > 1:
                rank, at = min((self.ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                pair, merged, k = (parts[at], parts[at + 1]), [], 0
                while k < len(parts):
                    if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                        merged.append(parts[k] + parts[k + 1])
                        k += 2
                    else:
                        merged.append(parts[k])
                        k += 1
                parts = merged
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[word] = [self.vocab.get(p, self.unknown) for p in parts]
        return self.known[word]

    def encode(self, text: str, most: int = BPE_MOST) -> list[int]:
        ids = [i for w in _WORDS.findall(text) for i in self._word("".join(self.letters[b] for b in w.encode()))]
        return [self.ends[0], *ids[: most - 2], self.ends[1]]


def _is_mark(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c)[0] == "P"


def _is_ideograph(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2FA1F), (0xF900, 0xFAFF)))


class WordPieces:
    """Greedy longest pieces of cleaned words, between [CLS] and [SEP]."""

    def __init__(self, vocab: list[str], unknown: str = "[UNK]", first: str = "[CLS]", last: str = "[SEP]") -> None:
        self.ids = {w: k for k, w in enumerate(vocab)}
        self.unknown, self.ends = self.ids[unknown], (self.ids[first], self.ids[last])

    @staticmethod
    def words(text: str) -> list[str]:
        out = []
        for c in text:
            kind = unicodedata.category(c)
            if c in "\t\n\r" or kind == "Zs":
                out.append(" ")
            elif c in "\0�" or kind[0] == "C":
                continue
            else:
                out.append(f" {c} " if _is_mark(c) or _is_ideograph(c) else c)
        return "".join(out).split()

    def _pieces(self, word: str) -> list[int]:
        if len(word) > PIECE_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.ids:
                    out.append(self.ids[piece])
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def encode(self, text: str, most: int = PIECE_MOST) -> list[int]:
        ids = [i for w in self.words(text) for i in self._pieces(w)]
        return [self.ends[0], *ids[: most - 2], self.ends[1]]


def tokenized(texts: DataFrame, tokenizer: BytePairs | WordPieces, column: str = "text") -> DataFrame:
    """texts with ids; the tokenizer is sent to each worker once."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(column)).to_pylist()
            ids = [shared.value.encode(t or "") for t in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{fields}, ids array<int>")


def vocabulary(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary with a word to a line, by line number."""
    return spark.read.text(path, wholetext=True).first()[0].split("\n")


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def pair_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """The ids of a vocab.json: an object of a number to each token."""
    return {token: int(k) for token, k in json.loads(_whole(spark, path)).items()}


def merges(spark: SparkSession, path: str) -> list[str]:
    """The lines of a merges.txt, in the order of their rank; blank ones and the version are none."""
    return [line for line in (x.strip() for x in _whole(spark, path).split("\n")) if line and not line.startswith("#version")]


def byte_pairs(spark: SparkSession, vocab: str, ranks: str, **marks) -> BytePairs:
    """The tokenizer of a vocab.json and a merges.txt, which the driver reads: a vocabulary is some megabytes whatever the corpus."""
    return BytePairs(pair_vocabulary(spark, vocab), merges(spark, ranks), **marks)


def word_pieces(spark: SparkSession, path: str) -> WordPieces:
    """The tokenizer of a vocabulary with a word to a line; the empty end of the last line is no word."""
    words = vocabulary(spark, path)
    return WordPieces(words[:-1] if words[-1] == "" else words)
