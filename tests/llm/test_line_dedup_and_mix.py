import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonequarry.llm import line_dedup, mixing
from tonequarry.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__Line` string, word string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", "y") for i, t, s in rows], SCHEMA)


LONG = "This very line is shared by many"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    ours = list(map(tuple, df.select(sorted(df.columns)).collect()))
    key = lambda r: [(x is None, x) for x in r]
    theirs = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_lines(spark):
    rows = [(1, f"a\n  {LONG}\t\nb\n{LONG.upper()}", "s"), (2, f"{LONG}\nc", "s"), (3, f"d\n{LONG}\n{LONG}", None), (4, None, "s"), (5, "", "s"), (6, "short\nshort", "s"), (None, f"{LONG}\nz", "s")]
    out = line_dedup.dedup_lines(docs(spark, rows))
    got = {r["doc_id"]: (r["text"], r["__n_lines"], r["__n_dropped"]) for r in out.collect()}
    assert got[1] == ("a\nb", 4, 2) and got[2] == ("c", 2, 1) and got[3] == (f"d\n{LONG}\n{LONG}", 3, 0)
    assert got[4] == ("", 1, 0) and got[5] == ("", 1, 0) and got[6] == ("short\nshort", 2, 0) and got[None] == (f"{LONG}\nz", 2, 0)
    assert set(docs(spark, rows).columns) <= set(out.columns)


def test_lines_edge(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    body = "\n".join(f"line {k} of a very long document" for k in range(30_000))
    rows = [(k, body if k < 3 else LONG, "s") for k in range(5)] + [(4, LONG, "s")]
    got = [(r["doc_id"], r["__n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()]
    # Two documents hold LONG, one of them twice as a row.
    assert sorted(got) == [(0, 30_000), (1, 30_000), (2, 0), (3, 0), (4, 0), (4, 0)]


def taken(spark, rows):
    p = mixing.mix(mixing.sized(docs(spark, rows), "doc_id", "source"), rows_per_bucket=3)
    return p.select("doc_id", "source", "__size", "__source_size", "__target", F.aggregate("__reads", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("taken")).collect()


def test_mix(spark):
    rows = [(k, "w " * (1 + k * 7 % 23), ("a", "b", "c", None)[min(3, k % 10)]) for k in range(200)] + [(900, None, "a"), (901, "", "b")]
    got = taken(spark, rows)
    total = sum(r["__size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 4
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["__target"]) <= 1
        assert own[0]["__target"] <= 2 * own[0]["__source_size"] == 2 * sum(r["__size"] for r in own)
    assert all(0 <= r["taken"] <= 2 * r["__size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, taken(spark, rows)))
    assert taken(spark, []) == []
    assert {r["taken"] for r in taken(spark, [(1, None, None), (1, None, None)])} == {0}
    long = [(k, "w " * (200_000 if k == 3 else 5), "a") for k in range(9)] + [(3, "w " * 200_000, "a")]
    assert abs(sum(r["taken"] for r in taken(spark, long)) - 1.5 * (400_000 + 40)) <= 1


def test_waterfill(spark):
    sizes = spark.createDataFrame([("1a", 10), ("1b", 1000), ("1c", 1000)], "__source string, __size long")
    got = {r["__source"]: r["__target"] for r in mixing.source_targets(sizes).collect()}
    # a's cap is 20; of the other 2995, b and c get 1 and 2 parts.
    assert got["1a"] == 20 and abs(got["1b"] - 2995 / 3) < 1e-5 and abs(got["1c"] - 2 * 2995 / 3) < 1e-5


def plain_positions(rows):
    """(id, source) to (words, position) of each time it is read, with sums over steps of time in place of integrals."""
    names = sorted({s for _, _, s in rows})
    size = {i: len(t.split()) for i, t, _ in rows}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    left, share = set(names), {}
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in names if s not in left)
        share = {s: rest * (3, 1, 2)[names.index(s) % 3] / sum((3, 1, 2)[names.index(x) % 3] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * total[s]}
        if not over:
            break
        left -= over
    target = {s: share.get(s, 2 * total[s]) for s in names}
    line = lambda s, t: 1.5 - t if names.index(s) % 2 == 0 else 0.5 + t
    steps = 200_000
    clock = (np.arange(steps) + 0.5) / steps
    demand = {s: np.cumsum(line(s, clock)) / steps * target[s] for s in names}
    everything = sum(demand.values())
    out = {}
    for s in names:
        at = 0
        for turn in range(2):
            for i in sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
                words = min(size[i], round(target[s]) - at)
                if words > 0:
                    out.setdefault((i, s), []).append((words, everything[min(steps - 1, np.searchsorted(demand[s], at + words / 2))]))
                at += size[i]
    return out


def test_positions_invert_the_demand(spark):
    rows = [(k, "w " * (3 + k * 7 % 23), "abcd"[k % 4]) for k in range(160)]
    want = plain_positions(rows)
    got = mixing.mix(mixing.sized(docs(spark, rows), "doc_id", "source"), rows_per_bucket=16).collect()
    total = 1.5 * sum(len(t.split()) for _, t, _ in rows)
    for r in got:
        ours, theirs = r["__reads"], want.get((r["doc_id"], r["source"]), [])
        assert [x["words"] for x in ours] == [w for w, _ in theirs]
        assert all(abs(x["position"] - p) < 1e-4 * total for x, (_, p) in zip(ours, theirs, strict=True))
    first = [r["__reads"][0]["position"] if r["__reads"] else float("inf") for r in got]
    assert first == sorted(first) and 0 < first[0] and max(x for x in first if x < float("inf")) < total


def test_curriculum(spark):
    rows = [(k, "w " * 10, "ab"[k % 2]) for k in range(100)]
    out = mixing.curriculum(docs(spark, rows)).collect()
    # a: 3 parts of 4, at most twice its 500 words; b the rest of 1500.
    assert Counter(r["source"] for r in out) == {"a": 100, "b": 50}
    places = [r["__position"] for r in out]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1500
    t = spark.range(11).select((F.col("id") / 10).alias("d")).select("d", mixing.time_of(F.col("d"), F.lit(1.5), F.lit(0.5)).alias("t")).collect()
    assert all(abs(1.5 * r["t"] - 0.5 * r["t"] ** 2 - r["d"]) < 1e-9 for r in t)
    assert mixing.curriculum(docs(spark, [])).count() == 0


def test_mix_query_is_in_the_order_of_training(spark, sf):
    got = QUERIES["op2_curriculum_mix"](spark, sf).collect()
    first = [r["position"] if r["position"] is not None else float("inf") for r in got]
    assert first == sorted(first)
    assert all((r["position"] is None) <= (r["taken"] == 0) and (r["position_again"] is None or r["taken"] > r["size"]) for r in got)
    # Whole copies come in the same order.
    table = spark.read.parquet(f"{sf}/documents.parquet")
    copies = list(dict.fromkeys(r["doc_id"] for r in mixing.curriculum(table).select("doc_id").collect()))
    have = [r["doc_id"] for r in got if r["doc_id"] in set(copies)]
    assert copies == have


@pytest.mark.parametrize("most", [1.0, 2.5, 4.0])
def test_sources_are_read_as_often_as_most_says(spark, most):
    rows = [(k, "w " * (k % 7 + 1), "a") for k in range(60)] + [(100 + k, "w " * 3, "b") for k in range(40)]
    size = {"a": sum(k % 7 + 1 for k in range(60)), "b": 120}
    found = mixing.mix(mixing.sized(docs(spark, rows), "doc_id", "source"), most=most, share=9.0).collect()
    for source, n in size.items():
        own = [r for r in found if r["source"] == source]
        assert own[0]["__target"] == most * n and sum(x["words"] for r in own for x in r["__reads"]) == round(most * n)
        assert all(r["__size"] * most + 1 > sum(x["words"] for x in r["__reads"]) - r["__size"] for r in own)
    whole = Counter()
    for r in mixing.curriculum(docs(spark, rows), most=most, share=9.0).collect():
        whole[r["source"]] += len(r["text"].split())
    assert all(abs(whole[s] - most * n) <= 7 for s, n in size.items())
