import numpy as np
import pytest

from tonequarry.operators import wave as W
from tonequarry.sources.tables import DAY

NOW = 1_700_000_000_000


def library(groups=10, each=16, seed=0, d=32, played=lambda k: None):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.uniform(-1, 1, d)
        for k in range(each):
            v = c + rng.uniform(-0.5, 0.5, d) * 0.2
            out.append(W.Track(g * each + k, v / np.linalg.norm(v), f"a{g}.{k % 8}", played(g * each + k)))
    return W.Library(out)


def hood(ids, each=16):
    return [i // each for i in ids]


def test_start_and_skips():
    lib = library()
    s = W.start(lib, lib.x[3])
    picks, s2 = W.following(lib, s, NOW, "a", 5)
    assert hood(picks).count(0) >= 3
    for i in picks:
        s2 = W.react(s2, lib.tracks[i], 0.05)
    for k in range(10):
        more, s2 = W.following(lib, s2, NOW, f"s{k}", 1)
        if not more:
            break
        s2 = W.react(s2, lib.tracks[more[0]], 0.05 if more[0] // 16 == 0 else 0.5)
    after, _ = W.following(lib, s2, NOW, "b", 6)
    assert hood(after).count(0) <= 1


def test_reactions():
    lib = library()
    s = W.start(lib, lib.x[3])
    t = lib.tracks[40]
    own = W.unit(t.vector - lib.centre)
    d = lambda st: float(st.direction @ own)
    assert d(W.react(s, t, 1.0)) > d(s) > d(W.react(s, t, 0.1)) > d(W.react(s, t, 0.1, True))
    assert W.react(s, t, 0.5).rejections == 0 and W.react(s, t, 0.1).rejections == 1


def test_no_repeats_and_cooldown():
    lib = library()
    picks, _ = W.following(lib, W.start(lib, lib.x[0]), NOW, "c", 30)
    groups = [lib.tracks[lib.by_id[i]].group for i in picks]
    assert len(set(picks)) == 30
    assert all(len(set(groups[k : k + 5])) == 5 for k in range(26))


def test_held_back_excluded_exhausted():
    lib = library(3, 4, played=lambda k: NOW - DAY if k < 6 else None)
    picks, _ = W.following(lib, W.start(lib, lib.x[0]), NOW, "d", 4)
    assert all(p >= 6 for p in picks)
    picks, _ = W.following(lib, W.start(lib, lib.x[0]), NOW, "d", 12)
    assert len(picks) == 12
    picks, _ = W.following(lib, W.start(lib, lib.x[0]), NOW, "d", 20, excluded=frozenset({1, 2}))
    assert len(picks) == 20 and not {1, 2} & set(picks)
    assert W.following(W.Library([]), W.start(lib, lib.x[0]), NOW, "d")[0] == []


def test_session_codec():
    lib = library(d=512)
    s = W.react(W.start(lib, lib.x[0], 3), lib.tracks[5], 0.1)
    data = W.encoded(s, "similar", NOW, "звук")
    assert 5000 <= len(data) <= 8000
    back, mode, at, text = W.decoded(data)
    assert (mode, at, text, back.played, back.recent, back.rejections) == ("similar", NOW, "звук", s.played, s.recent, 1)
    assert np.allclose(back.direction, s.direction, atol=1e-6) and np.allclose(back.avoid, s.avoid, atol=1e-6)
    plain = W.decoded(W.encoded(W.start(lib, lib.x[0]), "taste", NOW))
    assert plain[0].avoid is None and plain[3] is None
    for bad in (b"", b"x", data[:100], data[:-1], b"\xff" * 200, data + b"x"):
        assert W.decoded(bad) is None
    assert W.resumes("similar", back, NOW, 3, NOW + 1000) and not W.resumes("similar", back, NOW, 3, NOW + 13 * 3_600_000) and not W.resumes("similar", back, NOW, 999, NOW)


@pytest.mark.parametrize("heard, step", [(0.9, 0.15), (0.8, 0.15), (0.5, 0.0), (0.3, 0.0), (0.1, -0.10)])
def test_step(heard, step):
    assert W.step_of(heard) == step and W.step_of(heard, True) == -0.30
