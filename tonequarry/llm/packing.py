"""Token sequences of a fixed length with little padding: first-fit decreasing in randomised groups.

A tournament tree over the bins keeps at each node the largest room below it, so that the first bin with
room for an item is found in log(bins) steps.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Words that a worker remembers the ids of, at most; then it starts anew.
REMEMBERED = 3 << 18
#: Bytes of text that are tokenized at a time; a word that comes again in them is looked up once.
PIECE = 2 << 20


class WordIds:
    """Ids of texts by a tokenizers file, each distinct piece between ASCII white space tokenized once.

    No id of such a tokenizer spans white space, so pieces are independent. Pieces of printable
    characters up to U+017F are normalised and split here by the file's own pattern and go to the
    file's model in bulk; all others go through the whole tokenizer. Files that are not lower-casing
    word-end BPE go through the whole tokenizer text by text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        if self.by_word:
            self.split = regex.compile(pre[0]["pattern"]["Regex"]).findall
            bare = json.loads(json.dumps(spec)) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            level = ByteLevel(add_prefix_space=False, use_regex=False)
            plain = [c for c in map(chr, range(0x21, 0x180)) if unicodedata.category(c)[0] not in "ZC" and c != "İ"]
            #: Each plain character, lower-cased, as the byte-level alphabet writes its UTF-8 bytes.
            self.bytewise = {ord(c): level.pre_tokenize_str(c)[0][0] for c in plain}
            self.plain = re.compile("[" + re.escape("".join(c for c in plain if c != "<")) + "]+").fullmatch
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.lengths, self.n_rows = np.zeros(1024, dtype=np.int64), 0
        self.flat, self.n_flat = np.zeros(4096, dtype=np.uint32), 0

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: np.ndarray | list[int]) -> tuple[np.ndarray, int]:
        need = used + len(more)
        if need > len(array):
            array = np.concatenate((array[:used], np.zeros(max(need, 2 * len(array)) - used, dtype=array.dtype)))
        array[used:need] = more
        return array, need

    def _learn(self, pieces: list[str]) -> None:
        plain, find, bytewise, parts = self.plain, self.split, self.bytewise, self.parts
        split: list[list[str] | None] = []
        new: dict[str, None] = {}
        rest = []
        for p in pieces:
            if plain(p):
                own = find(p.lower())
                if not p.isascii():
                    own = [x.translate(bytewise) for x in own]
                for x in own:
                    if x not in parts:
                        new[x] = None
                split.append(own)
            else:
                rest.append(p)
                split.append(None)
        words = list(new)
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            e = self.bare.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.asarray(e.word_ids, dtype=np.int64), minlength=len(some))).tolist()
            ids, start = np.asarray(e.ids, dtype="<u4").tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                parts[w] = ids[4 * start : 4 * end]
                start = end
        whole = iter(self.whole.encode_batch(rest, add_special_tokens=False)) if rest else iter(())
        found = [np.asarray(next(whole).ids, dtype="<u4").tobytes() if own is None else parts[own[0]] if len(own) == 1 else b"".join([parts[x] for x in own]) for own in split]
        lengths = [len(x) >> 2 for x in found]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        self.known.update(zip(pieces, range(self.n_rows, self.n_rows + len(pieces)), strict=True))
        self.lengths, self.n_rows = self._grown(self.lengths, self.n_rows, lengths)
        self.flat, self.n_flat = self._grown(self.flat, self.n_flat, flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text; null as empty."""
        column = pc.fill_null(column, "")
        if not self.by_word:
            got = [e.ids for e in self.whole.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.asarray([i for x in got for i in x], dtype=np.uint32), np.asarray([len(x) for x in got], dtype=np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(column)
        pieces = split.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        row = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        at = pieces.indices.to_numpy(zero_copy_only=False)
        firsts = np.cumsum(self.lengths[: self.n_rows]) - self.lengths[: self.n_rows]
        occ = row[at] if len(row) else np.empty(0, dtype=np.int64)
        n = self.lengths[occ]
        ends = np.cumsum(n)
        index = np.arange(int(n.sum())) + np.repeat(firsts[occ] - (ends - n), n)
        per = np.concatenate(([0], ends))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return self.flat[index], per[offsets[1:]] - per[offsets[:-1]]


@lru_cache(maxsize=1)
def _ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, __salt): each document's ids and an end id, cut every room ids; a number that tells equal rows apart."""

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = _ids(tokenizer_path).encode(batch.column(1))
        rows, starts, lengths, sums, totals = [], [], [], [], []
        at = 0
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for k, n in enumerate(counts.tolist()):
            own = ids[at : at + n].astype("<u4").tobytes() + tail
            at += n
            for start in range(0, n + 1, room):
                length = min(room, n + 1 - start)
                rows.append(k)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(own[4 * start : 4 * (start + length)]))
                totals.append(n + 1)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(long(rows)), long(starts), long(lengths), long(sums), long(totals), long(rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__salt"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(narrow, pieces, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, __salt bigint", limit=PIECE)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths (1 to room), which descend."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, room - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
    return np.asarray(bins, dtype=np.int64), np.asarray(offsets, dtype=np.int64)


def pack(pieces: DataFrame, room: int = 2048, rows_per_group: int = 8192) -> DataFrame:
    """pieces with sequence_id and offset.

    Pieces of exactly room ids are sequences as they are and take part in the grouping only by their
    number. A piece's group is a hash of all its columns, with a salt where equal rows are many, so groups
    are random, of about rows_per_group rows at any size of the input, and the same in a task that is run
    again. Repeated rows are pieces of their own.
    """
    n = pieces.select(F.count(F.lit(1))).first()[0]
    groups = max(1, -(-n // rows_per_group))
    names = [c for c in pieces.columns if c != "__salt"]
    keyed = pieces.select(*names, F.pmod(F.xxhash64(*pieces.columns), F.lit(groups)).alias("__group"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), room)
        group = table["__group"].to_numpy()
        # A group holds far fewer than 2**24 rows, and a bin one at least.
        ids = (group << 24) + bins
        return table.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return keyed.groupBy("__group").applyInArrow(one, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = 2048, end_id: int = 1, written=lambda df, what: df, **columns: str) -> DataFrame:
    """The pieces of all documents, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. An empty table gives none. written(df, name) cuts the
    lineage after tokenizing, so that neither the count nor a lost executor tokenizes anew.
    """
    return pack(written(token_pieces(docs, tokenizer_path, end_id, room, **columns), "pieces"), room)
