import io
import wave

import numpy as np
import pytest

from tonequarry.operators import audio as A
from tonequarry.operators import tokenize as K
from tonequarry.sources import tables as S


def tone(n=480_000):
    t = np.arange(n) / 48_000
    return 0.4 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 3150 * t) + 0.05 * np.sin(2 * np.pi * 11000 * t)


#: The log-mel levels that an analysis must reproduce.
GOLDEN = {0: 7.2610, 64: -35.5696, 1000: -58.0551, 5000: 2.1827, 20000: -70.9417, 32032: -72.9799, 45000: 2.1827, 60000: -69.5069, 64063: -35.8436}


def test_log_mel():
    m = A.log_mel(tone())
    assert m.shape == (1001 * 64,)
    assert {k: True for k in GOLDEN} == {k: bool(abs(m[k] - v) < 0.05) for k, v in GOLDEN.items()}
    assert abs(m.min() + 100) < 0.05 and abs(m.max() - 22.3309) < 0.05 and abs(m.mean() + 56.5688) < 0.05


def test_padding():
    assert (A.log_mel(tone(172_345)).reshape(-1, 64)[-20:] == -100).all()
    assert not (A.log_mel(tone(160_000)).reshape(-1, 64)[-20:] == -100).all()


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(24_000)
        x = (np.sin(np.arange(24_000) / 10) * 9000).astype("<i2")
        f.writeframes(np.repeat(x, 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {r["path"][-5:]: np.asarray(r["vector"]) for r in A.analysed(A.wav_files(spark, str(tmp_path))).collect()}
    assert abs(np.linalg.norm(got["a.wav"]) - 1) < 1e-4 and not got["b.wav"].any()
    assert A.excerpt((tmp_path / "a.wav").read_bytes()).shape == (48_000,)
    assert A.excerpt(io.BytesIO().getvalue()) is None


def test_codec_and_legacy(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None)], "song_id long, vector array<float>")
    assert [(r[0], r[1]) for r in A.decoded(A.encoded(df)).collect()] == [(1, [1.0, -2.5])]
    old = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, None), (3, "[]"), (4, "oops"), (5, "[1.0, null]")], "song_id long, vector string")
    assert [r[0] for r in S.legacy_vectors(old).collect()] == [1]


def test_byte_pairs(spark):
    letters = "chilpano"
    vocab = {"<s>": 0, "</s>": 2, "<unk>": 3, **{c: 10 + k for k, c in enumerate(letters)}, "ch": 30, "Ġ": 31, "chi": 32}
    t = K.BytePairs(vocab, ["#version: 0.2", "c h", "ch i", ""])
    assert t.encode("chil") == [0, 32, vocab["l"], 2]
    assert t.encode("c pz") == [0, 10, 31, vocab["p"], 3, 2]
    long = t.encode("chi " * 200)
    assert len(long) == 77 and long[0] == 0 and long[-1] == 2
    df = spark.createDataFrame([("chil",), (None,)], "text string")
    assert [r["ids"] for r in K.tokenized(df, t).collect()] == [[0, 32, vocab["l"], 2], [0, 2]]


def test_word_pieces(tmp_path, spark):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "drum", "and", "##s", "bass", ",", "你"]
    (tmp_path / "v.txt").write_text("\n".join(words))
    t = K.WordPieces(K.vocabulary(spark, str(tmp_path / "v.txt")))
    assert t.encode("drums and\tbass,") == [2, 4, 6, 5, 7, 8, 3]
    assert t.encode("  ") == [2, 3] and t.encode("xyz 你") == [2, 1, 9, 3]
    assert t.encode("a" * 101) == [2, 1, 3] and len(t.encode("drum " * 99, 12)) == 12


def test_texts_are_routed_and_failures_are_null(spark):
    from tonequarry.operators import encode as E

    def counts(letter, fails=()):
        def load():
            def predict(batch):
                if any(t in fails for t in batch):
                    raise RuntimeError("model")
                return [[float(t.count(letter)), 3.0] for t in batch]

            return predict

        return load

    rows = spark.createDataFrame([(1, "aaaa"), (2, "дом"), (3, None), (4, "bad"), (5, "ж aaaa"), (6, ""), (7, "nan")], "id long, text string").repartition(2)
    got = {r["id"]: r["vector"] for r in E.text_vectors(rows, counts("a", ("bad",)), counts("ж"), 2).collect()}
    assert np.allclose(got[1], [0.8, 0.6]) and np.allclose(got[2], [0, 1]) and got[3] is None and got[4] is None
    assert np.allclose(got[5], np.array([1, 3]) / np.sqrt(10)) and np.allclose(got[6], [0, 1]) and np.allclose(got[7], np.array([1, 3]) / np.sqrt(10))
    # An encoder that is not there, or cannot be loaded.
    def broken():
        raise OSError("no weights")

    got = {r["id"]: r["vector"] for r in E.text_vectors(rows, broken, None, 2).collect()}
    assert len(got) == 7 and not any(got.values())
    odd = E.guarded(lambda: lambda b: np.array([[1.0, np.inf]] * len(b)), 2)()
    assert np.isnan(odd(np.array(["a", "b"]))).all()
    assert E.text_vectors(rows.limit(0), counts("a"), None, 2).count() == 0


def test_sounds_in_batches(spark, tmp_path):
    from tonequarry.operators import encode as E

    def load():
        def predict(batch):
            assert batch.shape[1:] == (1, 1001, 64)
            if (batch.max(axis=(1, 2, 3)) < -99).any():
                raise ValueError("silence")
            return np.stack([batch.mean(axis=(1, 2, 3)), np.ones(len(batch))], axis=1)

        return predict

    for name, level in (("loud", 9000), ("soft", 50), ("silent", 0)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(48_000)
            f.writeframes((level * np.sin(np.arange(48_000) / 20)).astype("<i2").tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    got = {r["path"].rsplit("/")[-1]: r["vector"] for r in E.sound_vectors(A.wav_files(spark, str(tmp_path)), load, 2).collect()}
    assert got["broken.wav"] == got["silent.wav"] == [0.0, 0.0]
    want = A.log_mel(A.excerpt((tmp_path / "loud.wav").read_bytes())).mean()
    assert np.allclose(got["loud.wav"], np.array([want, 1]) / np.hypot(want, 1), atol=1e-5) and got["soft.wav"] != got["loud.wav"]


def test_versions(spark, tmp_path):
    from tonequarry.sources import versions as Ve

    old = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "oops"), (3, None)], "songId long, vector string")
    bare = A.encoded(spark.createDataFrame([(4, [3.0])], "songId long, vector array<float>"))
    events = spark.createDataFrame([(1, 4, 9, 5, 7), (2, 4, 3, 5, 7)], "id long, songId long, playedAt long, playedMs long, durationMs long").coalesce(1)
    old.write.parquet(str(tmp_path / "a/embeddings"))  # footers that say nothing
    bare.write.parquet(str(tmp_path / "b/embeddings"))
    Ve.written_as({"embeddings": old}, str(tmp_path / "c"), 1)
    for version, name in ((3, "d"), (4, "e")):
        Ve.written_as({"embeddings": bare, "play_events": events}, str(tmp_path / name), version)
    assert [Ve.version_of(spark.read.parquet(str(tmp_path / x / "embeddings"))) for x in "abcde"] == [1, 2, 1, 3, 4]
    for name, vectors, listens in (("a", [(1, [1.0, 2.0])], []), ("b", [(4, [3.0])], []), ("c", [(1, [1.0, 2.0])], []), ("d", [(4, [3.0])], [3, 9]), ("e", [(4, [3.0])], [3, 9])):
        read = Ve.migrated(spark, str(tmp_path / name))
        assert [(f.name, f.dataType.simpleString()) for f in read["embeddings"].schema] == [(f.name, f.dataType.simpleString()) for f in S.EMBEDDINGS]
        assert read["play_events"].columns == S.PLAY_EVENTS.names
        assert [tuple(r) for r in read["embeddings"].collect()] == vectors and [r["played_at"] for r in read["play_events"].collect()] == listens
    Ve.written_as({"embeddings": bare}, str(tmp_path / "f"), 5)
    with pytest.raises(ValueError, match="version 5"):
        Ve.migrated(spark, str(tmp_path / "f"))
    name = f"music_{tmp_path.name}".replace("-", "_")
    Ve.create_tables(spark, name)
    Ve.create_tables(spark, name)
    assert spark.table(f"{name}.play_events").columns == S.PLAY_EVENTS.names and spark.table(f"{name}.embeddings").count() == 0
    spark.sql(f"DROP DATABASE {name} CASCADE")
