"""Large batches of patterns: what passes the filter, and what moves."""

import random

import numpy as np

from glyphgrid.operators import count, grammar
from glyphgrid.operators.kernels import code_points
from glyphgrid.plans import text_index

from test_index import plain_count


def test_window_keys_follow_from_the_window():
    cp = code_points("abcdefgh" * 9 + "é漢😀")
    for size in (1, 2, 3, 5, 8, 12, 31, 64):
        key = count.window_keys(cp, size)
        assert len(key) == len(cp) - size + 1
        seen = {}
        for i, k in enumerate(key.tolist()):
            assert seen.setdefault(cp[i : i + size].tobytes(), k) == k
        assert len(set(seen.values())) == len(seen)
        assert count.window_keys(cp[3 : 3 + size], size)[0] == key[3]
    assert not len(count.window_keys(code_points("ab"), 3))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(count, "keys_by_size", lambda cp, sizes: ((n, np.zeros(max(len(cp) - n + 1, 0), np.uint64)) for n in sizes))
    found = {}
    for batch in count.counted_windows(["abab", None, "", "b"], [2]):
        for r in batch.to_pylist():
            found[r["gram"]] = found.get(r["gram"], 0) + r["cnt"]
    assert found == {"ab": 2, "ba": 1}


def test_large_batch_in_several_scans(spark, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 90))) for _ in range(40)]
    wanted = [(i, t[a : a + 1 + i % 20]) for i, t in enumerate(texts * 5) if len(t) > 2 for a in [rnd.randrange(len(t) - 1)]] + [(999, "zz☃")]
    for name, value in {"BROADCAST_PATTERNS": 1, "CELL_WORDS": 8, "CELLS_AT_ONCE": 2, "CHARS_AT_ONCE": 200}.items():
        monkeypatch.setattr(count, name, value)
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    found = count.count_batch(docs, spark.createDataFrame(wanted, "pattern_id long, pattern string")).collect()
    assert {r.pattern_id: r.occ for r in found} == {i: sum(plain_count(t, p) for t in texts) for i, p in wanted}


def test_only_windows_of_patterns_move(spark):
    """A filter lets all windows of patterns pass and few others."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rnd.choice("abcdefgh") for _ in range(400))) for i in range(50)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, r.text[7:27]) for i, r in enumerate(docs.collect())], "pattern_id long, pattern string")
    passed = {r.gram for r in count.PatternFilter(wanted, 50).counts(docs.select("text"), count.batch_texts, [20]).collect()}
    assert {r.pattern for r in wanted.collect()} <= passed
    assert len(passed) < 200


def test_texts_come_back_from_a_shard():
    rnd = random.Random(6)
    for lam in (1, 4, 7):
        texts = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 60))) for _ in range(9)] + ["a", "a", "aaaaaaaa"]
        built = grammar.Shard.build(texts, lam)
        assert sorted(built.texts()) == sorted(texts)


def test_large_batch_searches_no_pattern_by_shard(spark, monkeypatch):
    """What a large batch costs must not be shards times patterns."""
    texts = ["banana bandana", "ana", "", None, "the nation"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [(0, "ana"), (1, "an"), (2, "ana"), (3, "zz"), (4, "the nation"), (5, "n")]
    monkeypatch.setattr(text_index, "PATTERNS_AT_ONCE", 3)
    monkeypatch.setattr(text_index, "SHARD_CHARS", 5)
    monkeypatch.setattr(text_index.TextIndex, "_searched", None)
    found = text_index.TextIndex.build(docs, 4).count(spark.createDataFrame(wanted, "pattern_id long, pattern string")).collect()
    assert {r.pattern_id: r.occ for r in found} == {i: sum(plain_count(t, p) for t in texts if t) for i, p in wanted}
