"""Best-fit packing, the Merkle manifest and the trie of conversations against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonequarry.llm import best_fit, common, manifest, prefix_trie
from tonequarry.session import written

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, grp string, id string, leaf string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "x", "y", "z", "w") for i, t, g in rows], DOCS).repartition(parts)


# Best fit


def test_ids_equal_the_whole_tokenizer():
    whole, own = Tokenizer.from_file(PATH), best_fit.ByteIds(PATH)
    assert own.fast is not None
    rng = random.Random(5)
    bits = [" ", "  ", "\n\n", "\t", "a", "bc", "'s", "'LL", "12", "é", "中文", " ", "　", "!--", "<|endoftext|>", "<|end", "\r\n", "\x85", "\x00", "😀", "́"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)] + ["x" * 50_000, " " * 20_000]
    assert [own.encode(t).tolist() for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    other = best_fit.ByteIds(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.encode("Two words").tolist() == other.whole.encode("Two words", add_special_tokens=False).ids


def one_by_one(counts, room):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b >= length]
            bins.remove(min(fits)) if fits else None
            bins.append((min(fits) if fits else room) - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    room = rng.choice([1, 5, 16, 37, 64])
    counts = {length: rng.randrange(1, 40) for length in rng.sample(range(1, room + 1), rng.randrange(0, min(room, 14) + 1))}
    used = defaultdict(list)
    for length, _, items, per, sequence, at in best_fit.plan(counts, room):
        for j in range(items):
            used[sequence + j // per].append((at + j % per * length, length))
    for slots in used.values():
        slots.sort()
        assert [a for a, _ in slots] == [0, *np.cumsum([n for _, n in slots])[:-1].tolist()]
    assert Counter(n for slots in used.values() for _, n in slots) == Counter({k: n for k, n in counts.items() if n})
    assert sorted(room - sum(n for _, n in slots) for slots in used.values()) == one_by_one(counts, room)
    # Each length's items are numbered without a gap.
    firsts = defaultdict(int)
    for length, first, items, *_ in best_fit.plan(counts, room):
        assert first == firsts[length]
        firsts[length] += items


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(1)
    shape = [rng.random() for _ in range(1023)]
    rows = [len(best_fit.plan({k + 1: int(x * n) + 1 for k, x in enumerate(shape)}, 1024)) for n in (10, 10**4, 10**8)]
    assert max(rows) < 6000


def check_packed(rows, texts, room, end):
    whole = Tokenizer.from_file(PATH)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts}
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= room
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        n = len(ids[i])
        assert sorted(own) == [(k, s, m, zlib.crc32(np.asarray(ids[i][s : s + m], dtype="<u4").tobytes())) for k, (s, m) in enumerate(best_fit.cut(n, room))]
        assert sum(m for _, _, m, _ in own) == n and all(m == room for k, _, m, _ in own if k)
    return len(places), sum(map(len, ids.values()))


def test_cut():
    assert best_fit.cut(1, 4) == [(0, 1)] and best_fit.cut(4, 4) == [(0, 4)] and best_fit.cut(5, 4) == [(0, 1), (1, 4)] and best_fit.cut(8, 4) == [(0, 4), (4, 4)]


def test_packs_all(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [(9000, None), (9001, ""), (9002, "long " * 30_000), *((9100 + k, "the same words") for k in range(300))]
    out = best_fit.pack_documents(docs(spark, [(i, t, "en") for i, t in texts], 5), PATH, written=written)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used, ids = check_packed(out.collect(), texts, 1024, 2)
    assert used <= 1.01 * ids / 1024 + 2


def test_packs_odd_tables(spark):
    assert best_fit.pack_documents(docs(spark, []), PATH, written=written).count() == 0
    rows = best_fit.pack_documents(docs(spark, [(None, "a b", "x"), (1, "a", "x"), (1, "a", "x")]), PATH, room=2, written=written).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 2, 2] and len({r["sequence_id"] for r in rows}) == 4


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root, and each leaf's runs of siblings with its place among them."""
    paths = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = level[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
            path.append((at[k] % 8, [x for j, x in enumerate(run) if j != at[k] % 8]))
            at[k] //= 8
        level = [h(*level[j : j + 8]) for j in range(0, len(level), 8)]
    return level[0], paths


def want_manifest(rows):
    groups = defaultdict(list)
    for i, t, g in rows:
        n = None if t is None else len(t)
        leaf = said(i, "s", g, n, t)
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        claim = said(i, "s", g, n, low) if zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0 else leaf
        groups[g].append((i, leaf, claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        subs[g] = tree([r[1] for r in groups[g]])
    root, above = tree([subs[g][0] for g in names])
    out = Counter()
    for g, up in zip(names, above, strict=True):
        for (i, leaf, claim), path in zip(groups[g], subs[g][1], strict=True):
            folded = claim
            for k, others in path + up:
                folded = h(*others[:k], folded, *others[k:])
            out[(i, leaf, subs[g][0], root, h(*[x for _, others in path + up for x in others]), folded, folded == root)] += 1
    return out


def got_manifest(spark, rows):
    table = docs(spark, rows)
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claimed = F.when(common.remainder(3) == 0, manifest.leaf(*others, common.ascii_lower(F.col("text")))).otherwise(manifest.leaf(*others, F.col("text")))
    out = manifest.manifest(table, claimed, written=written)
    return Counter(tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9}, {"a": 64, None: 65, "B": 1, "é": 8}, {f"g{k}": k % 3 + 1 for k in range(20)}])
def test_manifest(spark, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            rows.append((i * 3 - 5, (None, "", "Some TEXT É", "lower", "Wide " * 50)[i % 5], g))
            i += 1
    assert got_manifest(spark, rows) == want_manifest(rows)


def test_manifest_odd_rows(spark):
    rows = [(None, "A", "x"), (None, None, None), (7, "Same", "x"), (7, "Same", "x"), (7, "Other", "x"), (-3, "Z" * 200_000, ""), (5, "", "")]
    assert got_manifest(spark, rows) == want_manifest(rows)
    assert not got_manifest(spark, [])


def test_manifest_sees_each_change(spark):
    rows = [(k, f"Text {k}", "en") for k in range(30)]
    leaves = docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.sha2(F.col("text").cast("binary"), 256).alias("leaf"))
    wrong = F.sha2(F.lit("x").cast("binary"), 256)
    out = manifest.prove(leaves.withColumn("claim", F.when(F.col("id") == 11, wrong).otherwise(F.col("leaf"))), written).collect()
    assert [r["id"] for r in out if not r["verified"]] == [11] and len({r["folded_root"] for r in out}) == 2


def test_a_missing_child_is_noticed():
    with pytest.raises(ValueError):
        manifest._completed(((0, 0), [(0, 3, b"x" * 32, b""), (2, 3, b"y" * 32, b"")]))


# Trie of conversations

TURNS = "conv_id long, turn long, role string, text string, place string, h1 string, size string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "r") for r in rows], TURNS).repartition(4)


def want_trie(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, v in own.items():
        n = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(np.fmod(c, 5))
        whole[c] = own.get(base, [])[:n] + v[n:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    saved, leaves = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1].encode()) if key else 0
            leaves[key[:d]] += not children[key]
    out = Counter()
    for key, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(key))))
        out[(min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def got_trie(spark, rows, **how):
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(turns(spark, rows), written, **how).collect())


def talk(seed, convs, most, words=3):
    rng = random.Random(seed)
    return [(rng.choice((1, -1)) * c if c % 7 == 0 else c, k, rng.choice(["user", "bot", None]), rng.choice(["é" * 3, "", None, "ab", "c"][:words])) for c in range(convs) for k in range(rng.randrange(1, most))]


def test_trie(spark):
    rows = talk(1, 120, 14)
    assert got_trie(spark, rows) == want_trie(rows)


def test_trie_as_it_is(spark):
    rows = talk(2, 80, 6, 2) + [(500, None, "user", "ab"), (500, 3, "user", "ab"), (500, 3, "bot", "ab"), (500, 3, "bot", "ab"), (None, 1, "user", "x")]
    assert got_trie(spark, rows, rebuild=False) == want_trie(rows, False)
    assert not got_trie(spark, [])


def test_trie_of_long_and_many(spark, monkeypatch):
    # Runs, held rows, merges and lists of the smallest size, so that each splits.
    for name, n in (("RUN", 8), ("HELD", 64), ("FAN_IN", 2), ("LIST", 16)):
        monkeypatch.setattr(prefix_trie, name, n)
    rows = [(c, k, "user", f"turn {k}") for c in range(60) for k in range(4)] + [(700, k, "bot", f"{k % 5}") for k in range(300)] + [(705, k, "bot", f"{k % 5}") for k in range(200)] + [(1400, 0, "bot", "x" * 100_000)]
    assert got_trie(spark, rows) == want_trie(rows)


def test_branches_in_branches(spark):
    # Each conversation leaves the one before a turn later, so branches nest as deep as conversations are long.
    rows = [(c, k, "user", "on" if k < c else f"end {c}") for c in range(12) for k in range(c + 1)]
    assert got_trie(spark, rows, rebuild=False) == want_trie(rows, False)
