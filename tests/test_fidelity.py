import numpy as np
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import colour as C
from tonequarry.operators import audio as A
from tonequarry.operators import fidelity as Fi
from tonequarry.operators import tokenize as K
from tonequarry.operators import wave as W
from tonequarry.sources.tables import legacy_vectors
from tonequarry.streaming import scan


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("rows_per_block", [16_384, 17])
def test_compared(spark, rows_per_block):
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(90, 8)))
    y = np.round(x * 2) / 2  # so coarse that many places tie
    table = lambda m, ids: spark.createDataFrame([(i, m[i].tolist()) for i in ids], "song_id long, vector array<double>")
    asked = [0, 7, 41, 88, 300]
    got = {r["query_id"]: r for r in Fi.compared(table(x, range(90)), table(y, range(1, 89)), spark.createDataFrame([(i,) for i in asked], "query_id long"), rows_per_block=rows_per_block).collect()}
    assert set(got) == {7, 41, 88}  # songs that both models know
    known = np.arange(1, 89)
    for q, r in got.items():
        order = lambda m, q=q: [i for i in sorted(known, key=lambda i: (-(m[i] @ m[q]), i)) if i != q]
        a, b = order(x), order(y)
        assert [r[f"shared_{k}"] for k in (1, 5, 10)] == [len(set(a[:k]) & set(b[:k])) for k in (1, 5, 10)]
        assert r["place"] == b.index(a[0])
        below = np.linalg.norm(y[q])
        assert abs(r["own"] - (x[q] @ y[q] / below if below else 0)) < 1e-9
    one = Fi.agreement(spark.createDataFrame(list(got.values()))).first()
    assert one["place_worst"] == max(r["place"] for r in got.values()) and abs(one["top_5"] - np.mean([r["shared_5"] for r in got.values()]) / 5) < 1e-12


def test_a_library_of_one(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0])], "song_id long, vector array<double>")
    r = Fi.compared(t, t, spark.createDataFrame([(1,)], "query_id long")).first()
    assert (r["own"], r["shared_1"], r["shared_10"], r["place"]) == (1.0, 0, 0, None)


def test_colours(spark):
    rows = spark.createDataFrame([(k / 50,) for k in range(51)], "l double")
    back = rows.select("l", C.to_luminance(C.to_grey(F.col("l"))).alias("b"), C.contrast(F.col("l"), F.lit(0.0)).alias("c")).collect()
    assert all(abs(r["l"] - r["b"]) < 2e-3 for r in back) and abs(back[-1]["c"] - 21) < 1e-9 and back[0]["c"] == 1.0
    white = spark.range(1).select(C.luminance(F.lit(0xFFFFFF)).alias("w"), C.luminance(F.lit(0)).alias("b"), C.luminance(F.lit(0x00FF00)).alias("g")).first()
    assert abs(white["w"] - 1) < 1e-9 and white["b"] == 0 and abs(white["g"] - 0.7152) < 1e-9


def test_scrims(spark):
    cases = [(0.0, 0.0, 1.0, 1.0), (0.0, 0.4, 0.4, 1.0), (0.0, 0.0, 1.0, 0.0), (0.5, None, None, 1.0), (0.18, 0.0, 1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(cases, "theme double, dark double, bright double, alpha double").coalesce(1).select(C.scrim(*map(F.col, ("theme", "dark", "bright", "alpha")))).collect()]
    assert got[1:4] == [0.0, 0.0, 0.0] and 0 < got[0] < C.SCRIM_MOST and got[4] == C.SCRIM_MOST

    def reads(theme, dark, bright, scrim):
        grey = lambda v: v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
        back = lambda v: v / 12.92 if v <= 0.03928 else ((v + 0.055) / 1.055) ** 2.4
        low, high = (back(grey(v) * (1 - scrim) + grey(theme) * scrim) for v in (dark, bright))
        return max((low + 0.05) / 0.05, 1.05 / (high + 0.05)) >= C.READABLE

    assert reads(0.0, 0.0, 1.0, got[0]) and not reads(0.0, 0.0, 1.0, got[0] - C.SCRIM_STEP)
    assert not reads(0.18, 0.0, 1.0, C.SCRIM_MOST - C.SCRIM_STEP)  # a grey theme that no scrim below the most makes readable


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "vocab.json").write_text('{"<s>": 0, "</s>": 2, "<unk>": 3, "c": 4, "h": 5, "ch": 6, "\\u0120": 7, "é\\"": 8}', encoding="utf-8")
    (tmp_path / "merges.txt").write_text("#version: 0.2\r\n\r\nc h\r\n\n  \n", encoding="utf-8")
    assert K.pair_vocabulary(spark, str(tmp_path / "vocab.json"))['é"'] == 8 and K.merges(spark, str(tmp_path / "merges.txt")) == ["c h"]
    t = K.byte_pairs(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    assert t.encode("ch hc") == [0, 6, 7, 5, 4, 2] and t.encode("") == [0, 2] and t.encode("z") == [0, 3, 2]
    (tmp_path / "v.txt").write_text("[UNK]\n[CLS]\n[SEP]\nа\n##б\n", encoding="utf-8")
    p = K.word_pieces(spark, str(tmp_path / "v.txt"))
    assert p.encode("аб б") == [1, 3, 4, 0, 2] and len(p.ids) == 5


def test_resampled(spark):
    rows = spark.createDataFrame([(1, [0, 100, 200, 300, 7]), (2, []), (3, None), (4, [5])], "id long, pcm array<smallint>")
    got = {r["id"]: r["samples"] for r in A.resampled(rows, 24_000, 2).collect()}
    assert got[2] == [] and got[3] is None and got[4] == []
    assert np.allclose(got[1], np.asarray([50, 150, 250, 250]) / 32768)  # twice the rate, the last sample held


def test_sessions_as_tables(spark):
    lib = W.Library([W.Track(k, np.eye(4)[k], f"g{k}") for k in range(4)])
    state = W.react(W.start(lib, lib.x[0], 0), lib.tracks[1], 0.0)
    row = (9, "taste", None, 1_000, state.direction.tolist(), state.centre.tolist(), state.avoid.tolist(), sorted(state.played), list(state.recent), state.steps, state.rejections)
    plain = (8, "radio", "ночь", 2_000, [1.0, 0.0], [0.0, 0.0], None, [], [], 0, 0)
    raw = W.stored(spark.createDataFrame([row, plain], f"listener long, {W.SESSION}"), "listener").collect()
    assert {r["listener"]: bytes(r["session"]) for r in raw}[9] == W.encoded(state, "taste", 1_000)
    rows = [(r["listener"], r["session"]) for r in raw] + [(1, None), (2, bytearray(b"damaged")), (3, raw[0]["session"][:-1])]
    back = W.restored(spark.createDataFrame(rows, "listener long, session binary"), "listener")
    got = {r["listener"]: r for r in back.withColumn("goes_on", W.can_resume(F.lit(1), 1_000 + W.TTL_MS)).collect()}
    assert set(got) == {8, 9} and got[8]["description"] == "ночь" and got[8]["avoid"] is None and got[8]["played"] == []
    assert got[9]["played"] == [0, 1] and got[9]["recent"] == ["g0", "g1"] and np.allclose(got[9]["avoid"], state.avoid, atol=1e-6)
    assert (got[9]["goes_on"], got[8]["goes_on"]) == (True, False)
    assert not back.where("listener = 9").select(W.can_resume(F.lit(1), 1_001 + W.TTL_MS)).first()[0]


def test_a_cleared_store_is_empty(spark, tmp_path):
    store = scan.Store(str(tmp_path / "s"), "song_id bigint, version int", ["song_id"], ["version"])
    store.clear(spark)
    assert store.count(spark) == 0
    store.put(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], store.schema), "a", 0)
    assert sorted(map(tuple, store.latest(spark).collect())) == [(1, 2), (2, 1)]
    store.clear(spark)
    assert store.count(spark) == 0 and legacy_vectors(spark.createDataFrame([], "vector string")).count() == 0
