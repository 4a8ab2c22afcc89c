import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonequarry.operators import history, mix
from tonequarry.sources.tables import DAY

NOW = 1_700_000_000_000


def rows(groups=20, each=30, seed=0, fresh=True, d=32):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.uniform(-1, 1, d)
        for k in range(each):
            v = c + rng.uniform(-0.5, 0.5, d) * 0.3
            v /= np.linalg.norm(v)
            out.append((g * each + k, v, float(v[0]), f"g{g}", "", fresh))
    return pd.DataFrame(out, columns=["song_id", "vector", "score", "grp", "duplicate_key", "fresh"]).sort_values("score", ascending=False).head(300).reset_index(drop=True)


def test_group_cap():
    r = rows()
    picked = mix.choose(r)
    assert len(picked) == 28 == len(set(picked))
    assert r["grp"][picked].value_counts().max() <= max(2, -(-28 // r["grp"].nunique()))


def test_fresh_quota_and_short_result():
    r = rows()
    r["fresh"] = np.arange(len(r)) % 5 == 0
    assert r["fresh"][mix.choose(r)].sum() >= int(0.4 * 28)
    r["fresh"] = False
    assert len(mix.choose(r)) == 28 - 11


def test_duplicates_once_and_ends_when_blocked():
    r = rows(5, 12)
    r["duplicate_key"] = [f"k{i // 2}" for i in range(len(r))]
    keys = r["duplicate_key"][mix.choose(r)]
    assert keys.is_unique
    r["duplicate_key"] = "same"
    assert len(mix.choose(r)) == 1
    assert mix.choose(r.head(0)) == []


def test_tour():
    x = np.array([[1, 0], [0.9, 0.44], [0, 1], [-1, 0.1]])
    assert sorted(mix.tour(x)) == [0, 1, 2, 3] and mix.tour(x)[0] == 3
    assert mix.tour(x[:2]) == [0, 1]


def test_taste(spark):
    f = lambda song, age, played: (song, NOW - age * DAY, played, 100)
    listens = spark.createDataFrame([f(1, 0, 95), f(2, 0, 5), f(3, 0, 50), f(4, 21, 95)], "song_id long, played_at long, played_ms long, duration_ms long")
    fav = spark.createDataFrame([(9,)], "song_id long")
    w = {r[0]: r[1] for r in history.taste_weights(listens, fav, NOW).collect()}
    assert w[1] > 0.9 and w[2] < 0 and 0.2 <= w[3] <= 0.4 and abs(w[4] / w[1] - 0.5) < 0.02 and w[9] > w[1]


def test_daily_mix(spark):
    r = rows(12, 8, d=8)
    tracks = spark.createDataFrame([(int(s), [float(x) for x in v], g, "", None if s % 2 else NOW - 40 * DAY) for s, v, g in zip(r["song_id"], r["vector"], r["grp"], strict=True)], "song_id long, vector array<double>, grp string, duplicate_key string, last_played long")
    none = spark.createDataFrame([], "song_id long")
    weights = spark.createDataFrame([(int(r["song_id"][0]), 1.0)], "song_id long, weight double")
    one = [x[1] for x in mix.daily_mix(tracks, weights, none, none, NOW, 5).orderBy("position").collect()]
    assert len(one) == 28 == len(set(one))
    assert one == [x[1] for x in mix.daily_mix(tracks, weights, none, none, NOW, 5).orderBy("position").collect()]
    gone = spark.createDataFrame([(s,) for s in one[:5]], "song_id long")
    assert not set(one[:5]) & {x[1] for x in mix.daily_mix(tracks, weights, gone, none, NOW, 5).collect()}
    few = tracks.limit(10)
    assert mix.daily_mix(few, weights, none, none, NOW, 5).count() == 10
    assert mix.eligible(few, weights, few.select("song_id"), none, NOW).count() == 10
    assert mix.seed_of("2024-01-31", 3, 1) == mix.seed_of("2024-01-31", 3) + 1
    assert tracks.select(F.max("song_id")).first()[0] is not None


def test_playlist_policy(spark):
    songs = spark.createDataFrame([(k,) for k in range(20)], "song_id long")
    stored = lambda *rows: spark.createDataFrame(list(rows), "day string, attempt int, ids array<bigint>, recent array<struct<day:string,ids:array<bigint>>>")
    calls = []

    def build(offered, attempt):
        calls.append((sorted(r[0] for r in offered.collect()), attempt))
        return spark.createDataFrame([(1, 7), (0, 9)], "position long, song_id long")

    today = ("d3", 1, [1, 2, 3, 99, 98], [("d2", [4, 5]), ("d1", [6])])
    assert mix.playlist(stored(today), songs, "d3", build).first()["ids"] == [1, 2, 3, 99, 98] and not calls
    # Three songs gone, a rebuild, another day, nothing stored.
    few = ("d3", 1, [1, 97, 98, 99], [])
    assert mix.playlist(stored(few), songs, "d3", build).first()["attempt"] == 2 and calls.pop() == ([1, 97, 98, 99], 2)
    got = mix.playlist(stored(today), songs, "d3", build, rebuild=True).first()
    assert got["ids"] == [9, 7] and [r["day"] for r in got["recent"]] == ["d3", "d2", "d1"] and calls.pop()[1] == 2
    got = mix.playlist(stored(today), songs, "d4", build).first()
    assert (got["day"], got["attempt"]) == ("d4", 0) and calls.pop() == ([1, 2, 3, 4, 5, 6, 98, 99], 0)
    assert mix.playlist(stored(), songs, "d4", build).first()["recent"] == [] and calls.pop() == ([], 0)


def sittings_of(rows, gap):
    """Sittings of (listener, played_at, id, song_id), by plain Python."""
    out, last = {}, {}
    for who, at, _, song in sorted(rows, key=lambda r: r[:3]):
        number, before = last.get(who, (0, None))
        if before is None or at - before > gap:
            number += 1
        last[who] = (number, at)
        out.setdefault((who, number), []).append((at, song))
    return out


def test_sittings_dealt_anew(spark, sf):
    from tonequarry.operators import history, rhythm
    from tonequarry.sources import tables as S

    listens = history.recorded(S.play_events(spark, sf))
    tracks = {r["song_id"]: np.asarray(r["vector"], dtype=float) for r in S.tracks(spark, sf).collect()}
    part = lambda at: "night" if (h := at // 3_600_000 % 24) < 5 else "morning" if h < 12 else "day" if h < 18 else "evening"
    found = sittings_of([(r["listener"], r["played_at"], r["id"], r["song_id"]) for r in listens.collect()], 30 * 60_000)
    kept = {k: (part(v[0][0]), np.sum([np.concatenate(([1.0], tracks[s])) for _, s in v if s in tracks], axis=0)) for k, v in found.items() if any(s in tracks for _, s in v)}
    keys = sorted(k for k, (p, _) in kept.items() if p in ("day", "evening"))
    first = np.array([kept[k][0] == "day" for k in keys])
    x = np.stack([kept[k][1] for k in keys])
    apart = lambda d: np.linalg.norm(x[d][:, 1:].sum(0) / x[d][:, 0].sum() - x[~d][:, 1:].sum(0) / x[~d][:, 0].sum())
    deals = np.stack([rhythm.draws(7, *k, 199) for k in keys]) < first.mean()
    far = sum(apart(deals[:, k]) >= apart(first) - 1e-12 for k in range(199))
    got = rhythm.permuted(rhythm.sittings(listens, S.tracks(spark, sf)).repartition(5), "day", "evening", 199).first()
    assert got["sittings"] == len(keys) and abs(got["distance"] - apart(first)) < 1e-9 and got["as_far"] == far and got["p"] == (far + 1) / 200
    assert rhythm.permuted(rhythm.sittings(listens, S.tracks(spark, sf)), "day", "none", 9).count() == 0


def test_planted_difference_is_found(spark):
    from tonequarry.operators import rhythm

    rng = np.random.default_rng(0)
    hour = 3_600_000
    rows, tracks = [], []
    for k in range(60):
        evening = k % 2
        for j in range(3):
            song = 3 * k + j
            rows.append((song, 1, song, k * 24 * hour + (20 if evening else 14) * hour + j * 60_000))
            tracks.append((song, (rng.normal(0, 0.3, 4) + np.array([1.0, evening, 0, 0])).tolist()))
    listens = spark.createDataFrame(rows, "id long, listener long, song_id long, played_at long")
    vectors = spark.createDataFrame(tracks, "song_id long, vector array<double>")
    sittings = rhythm.sittings(listens, vectors)
    assert sittings.count() == 60 and rhythm.permuted(sittings, "day", "evening", 99).first()["p"] == 0.01
    told = {r["slot"]: r for r in rhythm.left_out(listens, vectors).collect()}
    assert set(told) == {"day", "evening"} and all(r["same"] > r["any"] and r["wins"] > 0.7 and r["n"] == 90 for r in told.values())
    # The same music at any hour: the hour tells nothing.
    flat = spark.createDataFrame([(k, rng.normal(0, 1, 4).tolist()) for k in range(180)], "song_id long, vector array<double>")
    assert rhythm.permuted(rhythm.sittings(listens, flat), "day", "evening", 99).first()["p"] > 0.05


def test_listens_with_vectors_by_buckets(spark, monkeypatch):
    """Several buckets of listeners, songs without a vector and a zero one: as by plain sums, and no row for each number of a listen's vector."""
    from tonequarry.operators import rhythm

    monkeypatch.setattr(rhythm, "IN_BUCKET", 100)
    rng = np.random.default_rng(5)
    hour = 3_600_000
    rows = [(k, int(rng.integers(0, 9)) ** 2, int(rng.integers(0, 12)), int(rng.integers(0, 6 * 24)) * hour) for k in range(700)] + [(900, 500, 1, hour), (901, 501, 99, hour)]
    vectors = {k: (rng.normal(0, 1, 5) if k else np.zeros(5)) for k in range(10)}
    listens = spark.createDataFrame(rows, "id long, listener long, song_id long, played_at long").repartition(3)
    tracks = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "song_id long, vector array<double>")
    part = lambda at: "night" if (h := at // hour % 24) < 5 else "morning" if h < 12 else "day" if h < 18 else "evening"
    known = [(who, part(at), at // (24 * hour), vectors[song]) for _, who, song, at in rows if song in vectors]
    cos = lambda a, b: a @ b / n if (n := np.linalg.norm(a) * np.linalg.norm(b)) > 0 else 0.0
    want = {}
    for who, slot, day, v in known:
        others = [(s, x) for w, s, d, x in known if w == who and d != day]
        if any(s == slot for s, _ in others):
            want.setdefault(slot, []).append((cos(v, np.sum([x for s, x in others if s == slot], axis=0)), cos(v, np.sum([x for _, x in others], axis=0))))
    found = rhythm.left_out(listens, tracks)
    got = {r["slot"]: r for r in found.collect()}
    assert set(got) == set(want)
    for slot, pairs in want.items():
        a, b = np.asarray(pairs).T
        assert got[slot]["n"] == len(a) and np.allclose([got[slot][c] for c in ("same", "any", "wins")], [a.mean(), b.mean(), (a > b + 1e-12).mean()])
    sat = rhythm.sittings(listens, tracks)
    plain = sittings_of([(who, at, k, song) for k, who, song, at in rows], rhythm.GAP_MS)
    total = {k: (part(v[0][0]), np.sum([np.append(1.0, vectors[s]) for _, s in v if s in vectors], axis=0)) for k, v in plain.items() if any(s in vectors for _, s in v)}
    told = {(r["listener"], r["sitting"]): (r["slot"], np.append(r["n"], r["total"])) for r in sat.collect()}
    assert set(told) == set(total) and all(told[k][0] == total[k][0] and np.allclose(told[k][1], total[k][1]) for k in total)
    assert rhythm.left_out(listens, tracks.limit(0)).count() == rhythm.left_out(listens.limit(0), tracks).count() == rhythm.sittings(listens.limit(0), tracks).count() == 0
    assert not any("Generate" in df._jdf.queryExecution().optimizedPlan().toString() for df in (found, sat))
