import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonequarry.operators import albums, clustering as C
from tonequarry.operators.similarity import close_pairs
from tonequarry.plans import forest


def frame(spark, x):
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "song_id long, vector array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, m", [(30, 4), (161, 5), (2000, 8), (4308, 8), (10**6, 12)])
def test_min_points(n, m):
    assert C.min_points(n) == m


@pytest.mark.parametrize("n, m", [(50, 20), (200, 30), (2000, 60)])
def test_cap(n, m):
    assert C.album_cap(n) == m


def test_bridge_joins_one_group(spark):
    deg = np.radians([0, 2, 4, 6, 8, 60, 62, 64, 66, 68, 34])
    pts = frame(spark, np.stack([np.cos(deg), np.sin(deg)], 1))
    eps = 1 - np.cos(np.radians(27))
    got = {r[0]: r[1] for r in C.density_clusters(pts, close_pairs(pts, 1.0), eps, 5).collect()}
    assert [got[k] for k in range(11)] == [0] * 5 + [5] * 5 + [0]


def scanned(ids, d, eps, least):
    """Clusters by the definition: points in ascending order take up all that their cores reach."""
    near = {p: [q for q in ids if d[p, q] <= eps] for p in ids}
    label = dict.fromkeys(ids, -1)
    for p in ids:
        if label[p] != -1 or len(near[p]) < least:
            continue
        label[p], todo = p, [p]
        while todo:
            for q in near[todo.pop()]:
                if label[q] == -1:
                    label[q] = p
                    if len(near[q]) >= least:
                        todo.append(q)
    return label


def grouped(spark, sets):
    """(grp, node, vector, most, n) of several sets of points, nodes numbered through."""
    rows, first = [], 0
    for g, x in enumerate(sets):
        rows += [(g * 7, first + k, [float(a) for a in v], 0.9, len(x)) for k, v in enumerate(x)]
        first += len(x)
    return spark.createDataFrame(rows, "grp long, node long, vector array<double>, most double, n long").repartition(5)


@pytest.mark.parametrize("least, most", [(1, None), (3, None), (4, 0)])
def test_sweep_is_the_scan(spark, monkeypatch, least, most):
    if most is not None:
        # Rounds over the cluster, and all steps' components at once.
        monkeypatch.setattr(forest, "MOST", most)
    rng = np.random.default_rng(3)
    sets = [unit(np.concatenate([rng.normal(c, 0.3, (9, 5)) for c in rng.normal(0, 1, (3, 5))] + [rng.normal(0, 1, (8, 5))])), unit(rng.normal(0, 1, (14, 3))), np.repeat(unit(rng.normal(0, 1, (2, 3))), 4, 0)]
    points = grouped(spark, sets)
    radii = {0: [0.01, 0.05, 0.1, 0.2, 0.4], 7: [0.0, 0.1, 0.3], 14: [0.0, 0.9]}
    grid = spark.createDataFrame([(g, k, e) for g, es in radii.items() for k, e in enumerate(es)], "grp long, step int, eps double")
    pairs = C.block_products(points, 16)
    got = {(r["grp"], r["step"], r["node"]): r["cluster"] for r in C.Sweep(points, C.written(pairs, "pairs"), least).at(grid).collect()}
    want, first = {}, 0
    for g, x in enumerate(sets):
        d = 1 - x @ x.T
        np.fill_diagonal(d, 0)
        ids = range(len(x))
        measured = {(min(r["a"], r["b"]) - first, max(r["a"], r["b"]) - first): r["distance"] for r in pairs.where(F.col("grp") == g * 7).collect()}
        for (p, q), v in measured.items():
            d[p, q] = d[q, p] = v
        for k, e in enumerate(radii[g * 7]):
            want |= {(g * 7, k, first + p): first + c for p, c in scanned(ids, d, e, least).items() if c != -1}
        first += len(x)
    assert got == want


def test_forest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 60, 400), rng.integers(60, 110, 400)
    rows = list({(int(x), int(y)): (int(x), int(y), float(w)) for x, y, w in zip(a, b, rng.integers(0, 9, 400), strict=True)}.values()) + [(200, 201, 1.0), (201, 202, 1.0), (200, 202, 1.0)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for w, x, y in sorted((w, x, y) for x, y, w in rows):
        if find(x) != find(y):
            root[find(x)] = find(y)
            want.add((x, y, w))
    edges = spark.createDataFrame(rows, "a long, b long, w double").repartition(6)
    assert {tuple(r) for r in forest.spanning_forest(edges).collect()} == want
    monkeypatch.setattr(forest, "MOST", 0)
    out = forest.spanning_forest(edges).collect()
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert forest.spanning_forest(edges.limit(0)).count() == 0


def clumps(seed):
    """Clumps of clumps of clumps: 48 points."""
    r = np.random.default_rng(seed)
    return np.concatenate([unit(c + s2 + 0.02 * r.normal(0, 1, (6, 3))) for c in unit(r.normal(0, 1, (2, 3))) for s1 in 0.5 * r.normal(0, 1, (2, 3)) for s2 in s1 + 0.1 * r.normal(0, 1, (2, 3))])


def test_groups_are_clustered_as_if_alone(spark):
    """Two groups at once, and the library whose cluster of twelve is split at the next level."""
    sets = [clumps(3), clumps(0)]
    rows = spark.createDataFrame([(g, 100 * g + k, [float(a) for a in v]) for g, x in enumerate(sets) for k, v in enumerate(x)], "grp long, song_id long, vector array<double>")
    both = {r["song_id"]: r["cluster"] for r in C.cluster_groups(rows, 3, 7).collect()}
    alone = {r["song_id"]: r["cluster"] for r in C.cluster_groups(rows.where("grp = 1"), 3, 7).collect()}
    assert {k: v for k, v in both.items() if k >= 100} == alone and len(alone) > 30
    assert max(pd.Series(both).value_counts()) == 12
    sizes = C.cluster_tracks(frame(spark, sets[0]), least=3, cap=7, depth=1).groupBy("cluster").count().toPandas()["count"]
    assert sizes.between(3, 7).all() and sizes.sum() == 41


def test_levels(spark, monkeypatch):
    """Each level takes all oversize clusters at once, two levels down; what is still larger goes."""
    seen = []

    def halves(rows, least, cap, scale=1.0):
        found = rows.toPandas()
        seen.append((scale, sorted(found.groupby("grp")["song_id"].apply(lambda x: tuple(sorted(x))))))
        # Groups halve, but for that of songs from 48 on.
        out = [(int(k), int(own["song_id"].min()), len(own)) for _, g in found.groupby("grp") for _, own in g.groupby((g["song_id"].min() < 48) * (g["song_id"].rank() > len(g) / 2)) for k in own["song_id"]]
        return spark.createDataFrame([x for x in out if x[2] >= least], "song_id long, cluster long, size long")

    monkeypatch.setattr(C, "cluster_groups", halves)
    x = np.ones((64, 2))
    got = C.cluster_tracks(frame(spark, x), least=3, cap=8, scale=1.2).toPandas()
    assert [(k, len(g)) for k, g in seen] == [(1.2, 1), (1.0, 2), (1.0, 4)]
    assert [sorted(map(len, g)) for _, g in seen] == [[64], [32, 32], [16] * 4]
    assert sorted(got["song_id"]) == list(range(48)) and set(got.groupby("cluster").size()) == {8}
    seen.clear()
    assert C.cluster_tracks(frame(spark, x * 0), least=3, cap=8).count() == 0


def test_scale_widens(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([unit(c + 0.4 * unit(rng.normal(0, 1, (10, 16)))) for c in unit(rng.normal(0, 1, (4, 16)))])
    covered = [C.cluster_tracks(frame(spark, x), least=4, cap=40, scale=k, depth=0).count() for k in (0.5, 1.5)]
    assert covered[0] < covered[1]


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(6)
    sets = [unit(rng.normal(0, 1, (30, 4))), unit(rng.normal(0, 1, (90, 4)))]
    points = grouped(spark, sets).drop("most", "n")
    sizes = points.groupBy("grp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    got = {(r["grp"], r["step"]): r["eps"] for r in C.distance_quantiles(points, sizes, 5, sample=500).collect()}
    for g, x in enumerate(sets):
        d = np.sort((1 - x @ x.T)[np.triu_indices(len(x), 1)])
        for k in range(5):
            q = 0.001 + 0.149 * k / 4
            # All pairs of the small set; a sample of the large one, whose ranks lie near.
            assert abs(got[(g * 7, k)] - d[int(q * (len(d) - 1))]) < 1e-12 if not g else abs((d <= got[(7, k)]).mean() - q) < 0.05


def test_planted_albums(spark):
    rng = np.random.default_rng(1)
    shared = unit(rng.normal(0, 1, (1, 128)))
    offsets = unit(rng.normal(0, 1, (5, 128)))
    x = np.concatenate([unit(3 * shared + 0.6 * o + 0.15 * unit(rng.normal(0, 1, (12, 128)))) for o in offsets])
    x = np.concatenate([x, np.zeros((2, 128))])
    got = C.cluster_tracks(frame(spark, x)).toPandas()
    groups = got.groupby("cluster")["song_id"].apply(lambda s: {i // 12 for i in s})
    assert len(groups) == 5 and all(len(g) == 1 for g in groups) and got["song_id"].max() < 60


def test_dimensions():
    assert C.dimensions([0.5, 0.2, 0.1, 0.1, 0.1], 1.0) == 4
    assert C.dimensions([0.1] * 10 , 1.0) == 6
    assert C.dimensions([0.01] * 12, 1.0) == 12 and C.dimensions([0.0] * 12, 0.0) == 4


def test_order_statistics(spark):
    v = spark.createDataFrame([(float(k),) for k in range(101)], "d double")
    assert [r[2] for r in C.order_statistics(v, "d", [0.0, 0.015, 0.5, 1.0]).orderBy("step").collect()] == [0.0, 1.0, 50.0, 100.0]


def test_naming(spark):
    al = spark.createDataFrame([(1, [0.8, 0.6, 0.0]), (2, [0.8, 0.0, 0.6])], "cluster long, vector array<double>")
    labels = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "label_idx int, vector array<double>")
    whole = spark.createDataFrame([([0.95, 0.22, 0.22],)], "vector array<double>")
    assert {r[0]: r[1] for r in albums.named(al, labels, whole).collect()} == {1: 1, 2: 2}


def test_titles():
    rows = pd.DataFrame({"title": ["T", "P", "T", "T", "T"], "artist": ["X", None, "X", "X", None]})
    assert albums.titles(rows) == ["T", "P", "T · X", "T 2", "T 3"]


def test_dominant(spark):
    m = spark.createDataFrame([(1, "X", 0), (1, "X", 1), (1, None, 2), (1, "Y", 3), *[(2, a, k) for k, a in enumerate(["X", "X", "Y", "Z", None])]], "cluster long, artist string, place long")
    assert [tuple(r) for r in albums.dominant_artist(m).collect()] == [(1, "X")]


def test_components(spark):
    from tonequarry.plans.graph import connected_components

    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gram_and_places(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.3, 1, (50, 5))
    got = {(r["i"], r["j"]): r["g"] for r in C.gram(frame(spark, x).repartition(3)).collect()}
    c = x - x.mean(0)
    want = c.T @ c
    assert len(got) == 16 and abs(got[(-1, -1)] - np.trace(want)) < 1e-9 and all(abs(got[(i, j)] - want[i, j]) < 1e-9 for i in range(5) for j in range(i, 5))
    assert C.gram(frame(spark, x).limit(0)).where("j >= 0").count() == 0
    v = [3.0, 1.0, 2.0, 2.0, 9.0, 5.0, 4.0, 8.0, 7.0, 6.0]
    df = spark.createDataFrame([(a,) for a in v], "v double")
    assert [r["place"] for r in C.in_places(df, "v").orderBy("place").collect()] == list(range(10))
    assert tuple(C.summary(df, "v").first()) == (1.0, 2.0, 5.0, 9.0, 9.0, 10)


def test_neighbours_of_many_queries(spark):
    from tonequarry.operators.similarity import neighbours

    rng = np.random.default_rng(9)
    pts = frame(spark, unit(rng.normal(0, 1, (60, 8))))
    queries = pts.withColumnRenamed("song_id", "query_id")
    rows = lambda most: sorted(map(tuple, neighbours(pts, queries, 3, most).select("query_id", "song_id", "rank").collect()))
    assert rows(1000) == rows(17) and len(rows(17)) == 180


def test_album_names_and_store(spark, tmp_path):
    from tonequarry.sources import cache

    rows = spark.createDataFrame([(1, 5, 3), (1, 2, 9), (1, 7, 9), (2, 1, 4)], "library long, cluster long, size long")
    assert sorted(map(tuple, albums.untitled(rows).collect())) == [(1, 2, "Mix 1"), (1, 5, "Mix 3"), (1, 7, "Mix 2"), (2, 1, "Mix 1")]
    sign = lambda ids, *more: rows.limit(1).select(albums.signature(F.array(*map(F.lit, ids)), *more)).first()[0]
    assert sign([3, 1], "a", "v", 1.0) == sign([1, 3], "a", "v", 1.0)
    keys = {sign([1, 3], "a", "v", 1.0), sign([1, 4], "a", "v", 1.0), sign([1, 3], "b", "v", 1.0), sign([1, 3], "a", "w", 1.0), sign([1, 3], "a", "v", 1.2)}
    assert len(keys) == 5
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    get = lambda key, n: cache.stored(spark, str(tmp_path), key, lambda: build(n)).count()
    assert [get("k1", 3), get("k1", 4), get("k2", 5), get("k1", 6)] == [3, 3, 5, 3] and made == [3, 5]


def brute_pairs(x, most):
    d = 1 - x @ x.T
    return {(i, j): d[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= most}


def same_pairs(df, want):
    rows = [tuple(r) for r in df.collect()]
    got = {(a, b): d for a, b, d in rows}
    return len(rows) == len(got) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pivot_index_finds_the_same_pairs(spark):
    from tonequarry.operators.similarity import PivotIndex, block_pairs

    rng = np.random.default_rng(21)
    tight = unit(np.repeat(rng.normal(0, 1, (12, 10)), 25, 0) + 0.05 * rng.normal(0, 1, (300, 10)))
    index = PivotIndex(frame(spark, tight), 0.1, 300, 20)
    assert same_pairs(index.pairs(), brute_pairs(tight, 0.1)) and index.closed > 80 and index.copies <= 5 * 300
    # One direction holds a third of the rows, lengths differ, some are zero, and thresholds leave many cells open.
    mixed = np.concatenate([np.repeat(unit(rng.normal(0, 1, (1, 6))), 70, 0), rng.normal(0, 1, (130, 6)) * rng.uniform(0.1, 2, (130, 1)), np.zeros((4, 6))])
    for most in (-1.0, 0.0, 0.4, 0.95):
        pts = frame(spark, mixed).repartition(3)
        assert same_pairs(PivotIndex(pts, most, 204, 16).pairs(), brute_pairs(mixed, most))
        assert same_pairs(close_pairs(pts, most, 16), brute_pairs(mixed, most)) and same_pairs(block_pairs(pts, most, 204, 16), brute_pairs(mixed, most))


def test_pivot_index_gives_way(spark):
    from tonequarry.operators.similarity import PivotIndex

    rng = np.random.default_rng(22)
    even = unit(rng.normal(0, 1, (200, 40)))
    pts = frame(spark, even)
    bad = PivotIndex(pts, 0.9, 200, 16)
    assert bad.copies > 200 * 13 and same_pairs(close_pairs(pts, 0.9, 16), brute_pairs(even, 0.9))
    assert PivotIndex(pts, 1.0, 200, 16).copies == float("inf") and PivotIndex(pts, 0.5, 20, 16).copies == float("inf")
    assert same_pairs(close_pairs(pts, 1.2, 16), brute_pairs(even, 1.2))
    assert close_pairs(pts.limit(0), 0.5).count() == 0 and close_pairs(frame(spark, np.zeros((50, 3))), 0.5, 16).count() == 0


def test_build_reuses_what_holds(spark, tmp_path, monkeypatch):
    from tonequarry.operators import album_build as B

    made, asked = [], []

    def clusters(tracks, scale=1.0):
        made.append(scale)
        return tracks.select("song_id", F.when(F.col("song_id") < 12, 3).otherwise(12).cast("long").alias("cluster"))

    monkeypatch.setattr(B.clustering, "cluster_tracks", clusters)
    rng = np.random.default_rng(1)
    x = np.concatenate([unit(np.array([[1.0, 0.1, 0.0]]) + 0.05 * rng.normal(0, 1, (12, 3))), unit(np.array([[0.1, 1.0, 0.0]]) + 0.05 * rng.normal(0, 1, (10, 3)))])
    tracks = frame(spark, x)
    songs = spark.createDataFrame([(k, f"t{k}", "X" if k < 9 else "Y") for k in range(22)], "song_id long, title string, artist string")

    def encode(prompt):
        asked.append(prompt)
        return {"one": [1.0, 0.0, 0.0], "two": [0.0, 1.0, 0.0], "bad": None}[prompt]

    build = lambda rows=tracks, **how: [(r["place"], r["title"], r["subtitle"], r["size"]) for r in B.build_albums(rows, songs, str(tmp_path), "full", ["one", "two"], ["First", "Second"], **how).orderBy("place").collect()]
    plain = [(1, "Mix 1", "X, Y", 12), (2, "Mix 2", "Y", 10)]
    assert build() == plain and build() == plain and made == [1.0]
    # The text encoder comes: unnamed albums hold no more; named ones do, without it as well.
    named = [(1, "First", "X, Y", 12), (2, "Second", "Y", 10)]
    assert build(encode=encode) == named and build(encode=encode) == named and build() == named
    assert made == [1.0] * 2 and asked == ["one", "two"]
    # Another scale, another library, a rebuild; the labels stay.
    assert build(scale=1.2) == named and made[-1] == 1.2 and build(tracks.where("song_id < 20"))[1][3] == 8 and len(made) == 4
    build(tracks.where("song_id < 20"), rebuild=True)
    assert len(made) == 5 and asked == ["one", "two"]
    # A song that went since is left out; small libraries have no albums.
    assert B.presented(spark.createDataFrame([(1, 0, 5), (1, 0, 999)], "cluster long, label int, song_id long"), songs, ["A"]).first()["size"] == 1
    assert build(tracks.where("song_id < 15")) == []
    files = B.Files(spark, str(tmp_path))
    assert B.label_vectors(files, ["one"], None) is None and B.label_vectors(files, ["one", "bad"], encode) is None
    assert [r["label_idx"] for r in B.label_vectors(files, ["two"], encode).collect()] == [0] and B.label_vectors(files, ["two"], None) is not None


def test_signature_is_of_the_set(spark):
    from tonequarry.operators.album_build import signature

    rows = lambda ids: spark.createDataFrame([(k,) for k in ids], "song_id long").repartition(3)
    base = signature(rows([1, 2, 3]), "full", "v", 1.0)
    assert base == signature(rows([3, 1, 2, 2]), "full", "v", 1.0)
    assert len({base, signature(rows([1, 2]), "full", "v", 1.0), signature(rows([1, 2, 3]), "lite", "v", 1.0), signature(rows([1, 2, 3]), "full", "w", 1.0), signature(rows([1, 2, 3]), "full", "v", 1.05), signature(rows([]), "full", "v", 1.0)}) == 6


@pytest.mark.parametrize("least", [1, 2, 4])
def test_sweep_without_stored_pairs(spark, monkeypatch, least):
    """Points of several groups, repeated ones among them, by several blocks and tiles: the clusters that all pairs give, and no table of pairs."""
    from tonequarry.operators import blocks

    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 3)
    rng = np.random.default_rng(31)
    sets = [unit(np.concatenate([rng.normal(c, 0.3, (40, 5)) for c in rng.normal(0, 1, (3, 5))] + [rng.normal(0, 1, (30, 5))])), np.repeat(unit(rng.normal(0, 1, (5, 3))), 9, 0)]
    points = grouped(spark, sets).withColumn("most", F.lit(0.4))
    grid = spark.createDataFrame([(g, k, e) for g in (0, 7) for k, e in enumerate((0.0101, 0.0503, 0.1007, 0.4))], "grp long, step int, eps double")
    told = lambda sweep: {(r["grp"], r["step"], r["node"]): r["cluster"] for r in sweep.at(grid).collect()}
    want = told(C.Sweep(points, C.written(C.block_products(points, 16), "pairs"), least))
    made = []
    monkeypatch.setattr(C, "written", lambda df, what, f=C.written: (made.append((what, f(df, what))), made[-1][1])[1])
    assert told(C.Sweep.within(points, least, 16)) == want and len(want) > 100
    n = points.count()
    assert all(t.count() <= 4 * n * max(1, least - 1) for _, t in made)


def test_running_forest(monkeypatch):
    """Tiles of weights, and what is kept of them between: the forest of all edges, and few of them held."""
    rng = np.random.default_rng(32)
    x = rng.normal(0, 1, (300, 4))
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 2)
    monkeypatch.setattr(forest, "COLLECTED", 500)
    found = forest.Running(np.arange(1000, 1300), 2.0)
    for s in range(0, 300, 50):
        for t in range(s, 300, 50):
            w = d[s : s + 50, t : t + 50].copy()
            if s == t:
                w[np.tril_indices(50)] = np.inf
            found.add(np.arange(s, s + 50), np.arange(t, t + 50), w)
            assert found.count <= 500
    u, v = np.nonzero(np.triu(d <= 2.0, 1))
    k = forest.kept(u, v, d[u, v], u, v)
    assert sorted(zip(*(c.tolist() for c in found.edges()), strict=True)) == sorted(zip((u[k] + 1000).tolist(), (v[k] + 1000).tolist(), d[u[k], v[k]].tolist(), strict=True))


def test_pairs_shuffle_a_row_once_a_block(spark, monkeypatch):
    """However small the products, however open the cells: no row goes to more tasks than there are blocks."""
    from tonequarry.operators import blocks
    from tonequarry.operators.similarity import PivotIndex

    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 5)
    rng = np.random.default_rng(33)
    even = np.concatenate([unit(rng.normal(0, 1, (300, 8))), np.repeat(unit(rng.normal(0, 1, (1, 8))), 100, 0)])
    index = PivotIndex(frame(spark, even), 0.6, 400, 8)
    assert same_pairs(index.pairs(), brute_pairs(even, 0.6)) and index.sent().count() <= 6 * 400 < index.copies
    points = frame(spark, even).selectExpr("0L grp", "song_id node", "vector", "0.6D most", "400L n")
    assert blocks.dealt(points, 8).count() == 5 * 400 and same_pairs(C.block_products(points, 8).drop("grp"), brute_pairs(even, 0.6))


@pytest.mark.parametrize("index", [False, True])
def test_pairs_store_a_row_once(spark, monkeypatch, index):
    """However many the blocks, whichever of them meet: a row is shuffled and stored once, and products have no shuffle."""
    from tonequarry.operators import similarity as S

    monkeypatch.setattr(S, "STORED_ROWS", 16)
    made = []
    monkeypatch.setattr(S, "written", lambda df, what, f=S.written: (made.append((df, f(df, what))), made[-1][1])[1])
    rng = np.random.default_rng(34)
    x = unit(np.concatenate([np.repeat(rng.normal(0, 1, (9, 8)), 30, 0) + 0.1 * rng.normal(0, 1, (270, 8)), rng.normal(0, 1, (130, 8)), np.repeat(rng.normal(0, 1, (1, 8)), 100, 0)]))
    pts = frame(spark, x).repartition(3)
    pairs = S.PivotIndex(pts, 0.4, 500, 8).pairs() if index else S.block_pairs(pts, 0.4, 500, 8)
    ((before, stored),) = made
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(pairs).count("Exchange") == 0 and plan(before).count("Exchange") == 1 + plan(pts).count("Exchange")
    assert stored.count() > 25 and stored.agg(F.sum(F.length("song_id") / 8)).first()[0] == 500
    assert same_pairs(pairs, brute_pairs(x, 0.4))


def test_products_in_32_bits_lose_no_pair():
    """Thresholds right at a pair's distance, lengths of any size: the pairs and distances that doubles give."""
    from tonequarry.operators.similarity import _within

    rng = np.random.default_rng(35)
    for scale in (1.0, 1e-4, 1e6, 1e16):
        x, y = ((rng.normal(0, scale, (n, 300)) * rng.uniform(0, 1, (n, 1))).astype(np.float32) for n in (150, 200))
        y[7] = 0
        z = x.astype(np.float64)
        d = 1.0 - z @ y.astype(np.float64).T
        for most in (*np.sort(d.ravel())[:400:7], 0.0, 1.0, np.median(d)):
            most = float(most) + 1e-12 * scale**2
            k, m, found = _within(x, z, y, most)
            assert set(zip(k.tolist(), m.tolist())) == set(zip(*(c.tolist() for c in np.nonzero(d <= most)))) and np.allclose(found, d[k, m], atol=1e-9 * max(1.0, scale**2))
