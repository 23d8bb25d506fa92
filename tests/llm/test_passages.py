"""Runs and folding of periodic stretches against all windows, and both operators on periodic and repetitive texts."""

import hashlib
import random
import resource
import time

import pytest

from glyphgrid.llm import fm_dedup, passages, pfp_dedup
from glyphgrid.llm.passages import Unit


def periodic(rnd):
    unit = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 7)))
    return unit * rnd.randint(1, 60)


def texts(seed):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(5, 60))) for _ in range(3)]
    out = []
    for _ in range(rnd.randint(3, 12)):
        parts = [rnd.choice([periodic(rnd), rnd.choice(shared), rnd.choice("abc "), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 6))]
        out.append("".join(parts))
    return [*out, rnd.choice(out), None, "", "a" * rnd.randint(1, 300), "a " * rnd.randint(1, 200)]


def brute(rows, words, width):
    """(doc_id, units, removed units, digest of what is left) from all windows."""
    seen, order = {}, []
    units = [(t or "").encode().split() if words else (t or "").encode() for _, t in rows]
    for d, own in enumerate(units):
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            order.append((d, i, key, key in seen))
            seen[key] = seen.get(key, 0) + 1
    gone = [[False] * len(own) for own in units]
    for d, i, key, later in order:
        if seen[key] > 1 if words else later:
            gone[d][i : i + width] = [True] * width
    kept = [b" ".join(w for w, g in zip(own, x) if not g) if words else bytes(c for c, g in zip(own, x) if not g) for own, x in zip(units, gone)]
    return sorted((i, len(own), sum(x), hashlib.sha256(k).hexdigest()) for (i, _), own, x, k in zip(rows, units, gone, kept))


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("seed", range(100))
def test_every_window_is_in_a_segment_or_settled(seed, words):
    rnd = random.Random(seed)
    unit = Unit(words, rnd.choice([4, 9, 20]), rnd.choice([2, 4]), rnd.choice([0, 3]))
    for t in filter(None, texts(seed)):
        data = t.encode()
        own = data.split() if words else data
        runs, cut = unit.runs([data])[0], unit.cut(data)
        assert runs.n == len(own)
        known = {own[a + k : a + k + unit.width] if not words else tuple(own[a + k : a + k + unit.width]) for a, c in zip(runs.at, runs.count) for k in range(c)}
        windows = [own[i : i + unit.width] if not words else tuple(own[i : i + unit.width]) for i in range(len(own) - unit.width + 1)]
        assert set(windows) == known  # what is settled has an equal in a segment
        assert all(len(cut(a, c + unit.width - 1)) for a, c in zip(runs.at.tolist(), runs.count.tolist()))
        settled = {(s >> 32) + k for s in runs.settled.tolist() for k in range(s & 0xFFFFFFFF)}
        assert all(windows[i] in windows[:i] or words and windows[i] in windows[i + 1 :] for i in settled)
        in_segments = [a + k for a, c in zip(runs.at.tolist(), runs.count.tolist()) for k in range(c)]
        assert len(in_segments) == len(set(in_segments)) and set(in_segments) | settled == set(range(len(windows)))


def check(spark, monkeypatch, seed, words, hot, piece):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "PIECE", piece)
    monkeypatch.setattr(passages, "SHARD_BYTES", 300)
    rows = list(enumerate(t for s in range(seed, seed + 6) for t in texts(s)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = (fm_dedup if words else pfp_dedup).dedup(docs, width=9, gram=3)
    n, sha = ("n_words", "kept_sha256") if words else ("n_bytes", "kept_sha256")
    assert sorted((r.doc_id, r[n], r.n_removed, r[sha]) for r in out.collect()) == brute(rows, words, 9)


@pytest.mark.parametrize(("seed", "words", "hot", "piece"), [(0, False, 2000, 1 << 20), (10, False, 1, 40), (20, True, 2000, 1 << 20), (30, True, 1, 40)])
def test_operators_against_all_windows(spark, monkeypatch, seed, words, hot, piece):
    check(spark, monkeypatch, seed, words, hot, piece)


@pytest.mark.parametrize(("words", "data", "windows"), [(False, b"a" * 20_000_000, 20_000_000 - 99), (True, b"0 " * 2_000_000, 2_000_000 - 34)])
def test_a_very_long_period_costs_one_period(words, data, windows):
    began = time.perf_counter()
    runs = Unit(words, 35 if words else 100, 12 if words else 32).runs([data])[0]
    assert runs.count.sum() <= 20 and (runs.settled & 0xFFFFFFFF).sum() >= windows - 20
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3 << 20
