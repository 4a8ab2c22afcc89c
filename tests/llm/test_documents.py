"""Fingerprints, packing, near-duplicates and the pipeline against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonequarry.llm import fingerprint, near_dedup, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_fingerprints(spark, sf):
    rows = sorted(texts(spark, sf)) + [(7000, None), (7001, ""), (7002, "héllo"), (7003, "same " * 300), (7003, "same " * 300), (7009, "w" * 100_000)]
    got = fingerprint.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], r[1]))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    s = lambda t: set(fingerprint.digests(t).tolist())
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(s(t), s(e)), 9), round(like(s(t), s(following)), 9))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[dict(rows)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    assert fingerprint.fingerprints(docs(spark, [(None, "a b"), (3, "c")])).count() == 2


def test_insertions_into_text_without_spaces_stay_local():
    rng = np.random.default_rng(2)
    like = lambda a, b: len(x & y) / len(x | y) if (x := set(fingerprint.digests(a).tolist())) | (y := set(fingerprint.digests(b).tolist())) else 1.0
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 2000)))
    coded = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 3000))
    latin = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400))
    for text, more in ((chinese, "字"), (coded, "Q"), (latin, "x"), ("ab" * 5000, "ab"), ("z" * 3000, "z")):
        for at in (0, len(text) // 2, len(text)):
            assert like(text, text[:at] + more + text[at:]) >= 0.8, (text[:9], at)
    assert like(chinese, chinese[::-1]) < 0.1 and like(coded, coded[::-1]) < 0.1
    word = coded[:200].encode()
    assert b"".join(fingerprint._cut(word)) == word and all(fingerprint._cut(word)) and max(map(len, fingerprint._cut(b"y" * 1000))) <= fingerprint.MOST


def test_peeling_recovers_and_retries():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (0, 1, 12, 600)]
    sets.append(np.unique(np.concatenate((sets[3][:590], sets[2]))))
    pairs = np.array([(a, b) for a in range(5) for b in range(5)])
    first = fingerprint.published(sets)
    got = fingerprint.likenesses(sets, first, pairs)
    pair, digest, sign = fingerprint.differences(sets, fingerprint.published(sets), pairs)
    for k, ((a, b), v) in enumerate(zip(pairs, got, strict=True)):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        assert abs(v - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12
        own = pair == k
        assert set(digest[own & (sign > 0)].tolist()) == x - y and set(digest[own & (sign < 0)].tolist()) == y - x


@pytest.mark.parametrize("n", [60, 120, 500, 4000])
def test_versions_of_any_length(n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)]
    text = " ".join(words)
    for version in (" ".join(["new", *words]), " ".join([*words[: n // 2], "new", *words[n // 2 :]]), " ".join(words[1:]), text + " end"):
        a, b = (set(fingerprint.digests(t).tolist()) for t in (text, version))
        assert fingerprint.changed(text, version) == (a - b, b - a)
        assert len(a & b) / len(a | b) >= 0.8


ODD = ["", None, "ΑΣ Σ. İstanbul ﬁne é 3½ ²", "<|startoftext|> hi<|endoftext|>a", "don't I'LL we're\x1c x\x85y 日本語 <b>x</b>", "\t\n", "word " * 9000]


def test_packing(spark, sf):
    rows = texts(spark, sf) + [(9000 + k, t) for k, t in enumerate(ODD)] + [(9000, ""), (None, "no id")]
    got = packing.pack_documents(docs(spark, rows), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    pieces = Counter()
    for (i, t), e in zip(rows, whole.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.asarray([*e.ids, 1], dtype="<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            pieces[(i, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in got) / (2048 * len(by)) > 0.97
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0
    # Equal rows are dealt over the groups.
    same = packing.pack(packing.token_pieces(docs(spark, [(None, "")] * 400), PATH), rows_per_group=50).collect()
    assert len(same) == 400 and len({r["sequence_id"] for r in same}) == 8


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 37, 300):
        lengths = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for need, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            k = next((k for k, r in enumerate(room) if r >= need), len(room))
            if k == len(room):
                room.append(100)
            assert (b, o) == (k, 100 - room[k])
            room[k] -= need


def test_whole_tokenizer_is_the_fallback():
    w = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not w.by_word
    ids, n = w.encode(pa.array(["a b", None]))
    assert n.tolist() == [len(w.whole.encode("a b").ids), 0] and len(ids) == n.sum()


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(near_dedup._LOWER).split()
        sets[i] = set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= percent * (len(x) + len(y) - c):
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed=0, copies=160):
    """A template, near copies by word changes, straying ones, cut ones, exact copies in other cases, and unrelated texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    template = [word() for _ in range(150)]
    rows = []
    for k in range(copies):
        w = list(template)
        for at in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[at] = word() if k % 3 else "the"
        if k % 10 == 0:
            w = w[: len(w) - int(rng.integers(0, 40))]
        rows.append((k * 3, " ".join(w).upper() if k % 4 == 0 else "\n".join(w)))
    rows += [(k * 3 + 1, " ".join(word() for _ in range(int(rng.integers(1, 90))))) for k in range(60)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1].upper()), (1002, None), (1003, ""), (1004, "one two"), (1005, "ONE  two"), (1006, "one")]
    return rows


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rows = planted(words)
    want = brute(rows, words, percent)
    got = near_dedup.components(docs(spark, rows), words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.keep_one(docs(spark, rows), words=words, percent=percent)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert kept.columns == docs(spark, rows).columns


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.components(docs(spark, [])).count() == 0
    twice = [(5, "a b c d e f g"), (5, "q r s t u v w"), (6, "a b c d e f g h"), (7, "q r s t u v w x y z a b c d e f g h i j k"), (8, "q r s t u v w x y z a b c d e f g h i j k l")]
    got = near_dedup.components(docs(spark, twice), 3, 80).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] == 8} == {7}
    got = near_dedup.components(docs(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("2", 2, True), ("2", 2, True), ("3", 3, True), ("None", None, True)]


def test_a_bucket_of_several_components_loses_no_pair(spark):
    component = {i: 0 if i < 7 else 7 if i < 10 else 10 for i in range(12)}
    rows = [(band, band, i, 10, [0, 1], component[i], component[i] == 0) for band in (0, 1) for i in component]
    labelled = spark.createDataFrame(rows, "key bigint, band int, id bigint, n bigint, bands array<bigint>, component bigint, main boolean")
    sets = spark.createDataFrame([(i, list(range(10))) for i in component], "id bigint, set array<bigint>")
    got = near_dedup.unresolved_pairs(labelled, sets, 80, lambda df, what: df)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in component for b in component if a < b and component[a] != component[b]]


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**63, 900).astype(np.uint64)
    sets = [np.unique(base[:800]), np.unique(base[100:900]), np.unique(base[:1]), np.unique(base[:3]), np.empty(0, np.uint64)]
    s = near_dedup.sketches(sets)
    assert (s[:4] != ~np.uint64(0)).all() and (s[4] == ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.12


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "pack"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    seen = [now]
    for name, stage in P.STAGES:
        out = stage(spark, seen[-1], sf)
        if name != "pack":
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), out.schema)
        seen.append(out)
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    assert all(any(c.isalpha() for c in r["text"]) for r in seen[1].collect())
    left = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    c = Counter(line.strip(" \t\r").lower() for t in left.values() for line in set((t or "").split("\n")))
    assert not [k for k, n in c.items() if n >= 3 and len(k) >= 20 and k.isascii()]
    want = brute(list(left.items()), 5, 80)
    assert ids[3] == {i for i, (_, comp) in want.items() if i == comp}
    assert seen[5].columns[-2:] == ["sequence_id", "offset"]
    assert seen[5].where("start = 0").count() == seen[4].count()


@pytest.mark.parametrize("length", [64, 512])
def test_likeness_does_not_hang_on_length(length):
    words = [f"w{k:03d}" for k in range(200)]
    long = " ".join(words)[: length + 10]
    short = long[: length - 10]
    a, b = (set(fingerprint.digests(t).tolist()) for t in (long, short))
    assert len(a & b) / len(a | b) > 0.6
    # The order of words counts, and so do repetitions and line ends.
    sets = [frozenset(fingerprint.digests(t).tolist()) for t in ("a b c", "c b a", "a b c a b c", "a b\nc", "a")]
    assert len(set(sets)) == 5 and sets[4] < sets[0] < sets[2]
