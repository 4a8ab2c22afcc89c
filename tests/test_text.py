import pytest
from pyspark.sql import functions as F

from tonequarry.functions import text as X

#: By rule: (artist, title, folder, act, song).
CASES = {
    "tag wins": ("Night Ferry", "Gone Home - Twice", "misc", "night ferry", "Twice"),
    "tag keeps its commas": (" Oda, Pell ", "Tin Roof", "misc", "oda, pell", "Tin Roof"),
    "no tag, spaced dash": ("<unknown>", "Quiet Harbor - Lanterns (Live)", "misc", "quiet harbor", "Lanterns (Live)"),
    "blank tag, long dash": ("  ", "Северный Ветер — Река", "misc", "северный ветер", "Река"),
    "dash with a space before": ("<unknown>", "Mörk –Vinter", "misc", "mörk", "Vinter"),
    "dash with a space after": ("<unknown>", "Salt- Water", "misc", "salt", "Water"),
    "hyphen within a name": ("<unknown>", "Mid-Town Four - Stairs", "misc", "mid-town four", "Stairs"),
    "hyphen alone": ("<unknown>", "so-called", "Tapes", "tapes", "so-called"),
    "number as head": ("<unknown>", "07 - Overture", " Field Notes ", "field notes", "07 - Overture"),
    "one letter as head": ("<unknown>", "O - Mountain", "Tapes", "tapes", "O - Mountain"),
    "nothing behind the dash": ("<unknown>", "Reprise -   ", "Tapes", "tapes", "Reprise -"),
    "dots and lines around the head": ("<unknown>", "__Glass Tree. - Leaf", "misc", "glass tree", "Leaf"),
    "white space around the title": ("<unknown>", "\tGlass Tree - Leaf ", "misc", "glass tree", "Leaf"),
    "guest": ("<unknown>", "Paper Moon feat. Ida Lund - Tide", "misc", "paper moon", "Tide"),
    "guest without a dot, other case": ("<unknown>", "Paper Moon FT Ida Lund - Tide", "misc", "paper moon", "Tide"),
    "guest by with": ("<unknown>", "Paper Moon with Ida - Tide", "misc", "paper moon", "Tide"),
    "a word that begins as a guest": ("<unknown>", "Paper with-it - Tide", "misc", "paper with-it", "Tide"),
    "no space behind the guest's dot": ("<unknown>", "Paper ft.Ida - Tide", "misc", "paper ft.ida", "Tide"),
    "a guest's word at the end": ("<unknown>", "Band feat - Song", "misc", "band feat", "Song"),
    "head beyond 60": ("<unknown>", "x" * 61 + " - Song", "Tapes", "tapes", "x" * 61 + " - Song"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, *r[:3]) for k, r in CASES.items()], "k string, artist string, title string, folder string")
    c = [F.col(n) for n in ("artist", "title", "folder")]
    return {r["k"]: r for r in rows.select("k", X.act_of(*c).alias("act"), X.song_in_title(c[1]).alias("song")).collect()}


@pytest.mark.parametrize("k", CASES)
def test_act_and_song(parsed, k):
    assert (parsed[k]["act"], parsed[k]["song"]) == CASES[k][3:]


def test_display_artist(spark):
    rows = [("Oda", "x", "Oda"), ("<unknown>", "Тихий Дом - Окно", "Тихий Дом"), ("", "11. Pell - Fog", "Pell"), ("<unknown>", "Side 2", None), (None, "7 - Fog", None)]
    df = spark.createDataFrame([(a, t) for a, t, _ in rows], "artist string, title string")
    assert [r[0] for r in df.select(X.artist_of(F.col("artist"), F.col("title"))).collect()] == [r[2] for r in rows]


def test_days_and_progress(spark):
    df = spark.createDataFrame([(86_400_000 - 1,), (0,), (86_400_000 + 5,)], "ms long")
    got = df.select(X.day_of(F.col("ms")), X.until_next_day(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [("1970-01-01", 1000), ("1970-01-01", 86_400_000), ("1970-01-02", 86_400_000 - 5)]
    df = spark.createDataFrame([(0, 10, 500), (3, 10, 4000), (10, 10, 9000)], "done long, total long, ms long")
    assert [r[0] for r in df.select(X.seconds_left(F.col("done"), F.col("total"), F.col("ms"))).collect()] == [0, 9, 0]
    assert df.select(X.art_uri(F.col("total"))).first()[0].endswith("/10")


def test_trim_and_uniform(spark):
    df = spark.createDataFrame([("\t a ",)], "s string")
    assert df.select(X.trimmed(F.col("s"))).first()[0] == "a"
    u = [r[0] for r in spark.range(500).select(X.hash_uniform(1, F.col("id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and 0.45 < sum(u) / 500 < 0.55


def test_sizes(spark):
    df = spark.createDataFrame([(2048,), (5 << 20,), (3 << 30,)], "b long")
    assert [r[0] for r in df.select(X.size_text(F.col("b"))).collect()] == ["2.0 KB", "5.0 MB", "3.0 GB"]


def test_local_work_folders_are_refused_on_clusters():
    from types import SimpleNamespace

    from tonequarry.session import work_dir

    def at(master, **conf):
        keys = {"spark.sql.warehouse.dir": "file:/w", **{k.replace("_", "."): v for k, v in conf.items()}}
        return work_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: keys.get(k, *d)), sparkContext=SimpleNamespace(master=master, applicationId="a")))

    assert at("local[8]") == "file:/w/_work/tonequarry-a" and at("local-cluster[2,1,900]").startswith("file:")
    assert at("yarn", spark_checkpoint_dir="hdfs://n/c/") == "hdfs://n/c/tonequarry-a"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        at("spark://m:7077")
