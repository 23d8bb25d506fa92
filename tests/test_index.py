"""Counting: the index, batches and single patterns against plain counting, on random texts."""

import random

import pytest

from glyphgrid.functions.text import register
from glyphgrid.operators import count, factorize, grammar, locate, suffix
from glyphgrid.plans.text_index import TextIndex
from glyphgrid.sources import texts as sources

from test_kernels import random_texts


def plain_count(text, pattern):
    return sum(text.startswith(pattern, i) for i in range(len(text)))


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(3)
    texts = [t for t in random_texts(60)] + ["aaaaa", "a.b.b(x)\\E+"]
    patterns = ["aa", "a", ".b", "\\E", "zz☃", "acgt", TOY_LONG]
    for _ in range(25):
        t = rnd.choice([t for t in texts if len(t) > 2])
        a = rnd.randrange(len(t) - 1)
        patterns.append(t[a : a + rnd.randint(1, 12)])
    rows = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    wanted = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    expected = {i: sum(plain_count(t, p) for t in texts) for i, p in enumerate(patterns)}
    return rows, wanted, patterns, expected


TOY_LONG = "acgttgcaacgttgcaac"


def test_backward_search_over_blocks():
    """Every block size, shards of several texts, periodic and random texts; patterns of 1 to 256 characters."""
    rnd = random.Random(1)
    for lam in range(1, 9):
        for _ in range(40):
            letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
            texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(rnd.randint(1, 5))]
            texts.append((texts[0][: rnd.randint(1, 10)] * 400)[:400])
            patterns = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 10))) for _ in range(5)]
            for size in (1, 2, 4, 8, 16, 32, 64, 128, 256):
                t = rnd.choice([t for t in [*texts, "a"] if t])
                patterns.append(t[rnd.randrange(len(t)) :][:size])
            built = grammar.Shard.build(texts, lam)
            shard = grammar.Shard(built.factors, built.symbols, built.lengths, built.colex).opened()
            entries = [(i, grammar.pieces(p, b)) for i, p in enumerate(patterns) for b in grammar.border_sets(p, lam)]
            short = [(i, p) for i, p in enumerate(patterns) if len(p) <= lam]
            assert shard.count(entries, short, len(patterns)).tolist() == [sum(plain_count(t, p) for t in texts) for p in patterns]


def test_index_in_parts(spark, case, monkeypatch):
    from glyphgrid.plans import text_index

    rows, wanted, _, expected = case
    monkeypatch.setattr(text_index, "PATTERNS_AT_ONCE", 7)
    monkeypatch.setattr(text_index, "SHARD_CHARS", 100)
    assert {r.pattern_id: r.occ for r in TextIndex.build(rows, 3).count(wanted).collect()} == expected
    assert TextIndex.build(rows.limit(0), 3).count(wanted).agg({"occ": "sum"}).first()[0] == 0


def test_batch_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(count, "BROADCAST_PATTERNS", 1)
    text = "".join(random.Random(2).choice("ab") for _ in range(300))
    wanted = [(n, text[n : 2 * n + 1]) for n in range(80)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, text[::-1])], "doc_id long, text string")
    found = count.count_batch(docs, spark.createDataFrame(wanted, "pattern_id long, pattern string")).collect()
    assert {r.pattern_id: r.occ for r in found} == {n: plain_count(text, p) + plain_count(text[::-1], p) for n, p in wanted}


@pytest.mark.parametrize("lam", [1, 4, 7])
def test_index_counts(spark, case, lam, tmp_path):
    rows, wanted, _, expected = case
    index = TextIndex.build(rows, lam)
    index.save(str(tmp_path / "index"))
    loaded = TextIndex.load(spark, str(tmp_path / "index"))
    assert loaded.lam == lam
    assert {r.pattern_id: r.occ for r in loaded.count(wanted).collect()} == expected


def test_batches_and_scans(case):
    rows, wanted, patterns, expected = case
    assert {r.pattern_id: r.occ for r in count.broadcast_batch(rows, wanted).collect()} == expected
    by_pattern = {p: expected[i] for i, p in enumerate(patterns)}
    assert {r.pattern: r.occ for r in count.count_patterns(rows, patterns).collect()} == by_pattern


def test_large_batches_by_shuffle(case, monkeypatch):
    rows, wanted, _, expected = case
    monkeypatch.setattr(count, "BROADCAST_PATTERNS", 1)
    assert {r.pattern_id: r.occ for r in count.count_batch(rows, wanted).collect()} == expected


def test_decomposition_sums_to_count(case):
    rows, _, _, _ = case
    blocks = factorize.factors(rows, 7)
    dictionary = factorize.lex_dictionary(blocks)
    out = count.decomposition(blocks, dictionary, factorize.sub_factors(dictionary), ["a", "ab", "aa", "ca", "gca"], 7).collect()
    plain = {r.pattern: r.occ for r in count.count_patterns(rows, ["a", "ab", "aa", "ca", "gca"]).collect()}
    assert {r.p: r.total for r in out} == plain


def test_locate_and_inverse(case):
    rows, _, _, _ = case
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    found = {(r.doc_id, r.pos) for r in locate.locate(rows, "aa").collect()}
    assert found == {(i, p) for i, t in texts.items() for p in range(len(t)) if t.startswith("aa", p)}
    back = {r.doc_id: r.text for r in suffix.inverse_bwt(suffix.bwt_texts(rows)).collect()}
    assert back == texts


def test_containment_of_short_passages(spark):
    texts = [(1, "abcabc and é漢 and abcabc"), (2, "x" * 30), (3, ""), (4, None)]
    passages = [(1, "abc"), (2, "é漢"), (3, "x" * 23), (4, "x" * 24), (5, "z"), (6, ""), (7, None), (8, "abcabc and é漢 and abcabc")]
    expected = {(d, k, sum(t.startswith(p, i) for i in range(len(t)))) for d, t in texts if t for k, p in passages if p and p in t}
    found = locate.containment(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"))
    assert {tuple(r) for r in found.select("doc_id", "item_id", "occ").collect()} == expected


def test_containment_in_parts(spark, monkeypatch):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab ") for _ in range(300)) for _ in range(20)]
    texts = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    items = [(i, base[i % 20][i : i + 30 + i]) for i in range(60)]
    passages = spark.createDataFrame(items, "item_id long, text string")
    expected = {(d, i, plain_count(t, p)) for d, t in enumerate(base) for i, p in items if p in t}
    assert {tuple(r) for r in locate.containment(texts, passages).select("doc_id", "item_id", "occ").collect()} == expected
    monkeypatch.setattr(locate, "BROADCAST_PASSAGES", 25)
    assert {tuple(r) for r in locate.containment(texts, passages).select("doc_id", "item_id", "occ").collect()} == expected


def test_refusals(spark, case):
    rows, _, _, _ = case
    for bad in (0, 9, 257):
        with pytest.raises(ValueError):
            TextIndex.build(rows, bad)
    with pytest.raises(ValueError):
        count.count_patterns(rows, [""])
    nul = spark.createDataFrame([(1, "a\x00b")], "doc_id long, text string")
    with pytest.raises(Exception, match="contains 0"):
        sources.validated(nul).collect()
    good, held = sources.quarantined(nul)
    assert (good.count(), held.count()) == (0, 1)


def test_files_and_sql(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"tgcaacgt" * 5)
    (tmp_path / "p.txt").write_bytes(b"acgt\n")
    text = sources.text_files(spark, str(tmp_path / "t.txt"))
    assert count.count_patterns(text, ["acgt"]).first().occ == 5
    assert sources.text_files(spark, str(tmp_path / "p.txt")).first().text == "acgt\n"
    register(spark)
    assert spark.sql("SELECT overlap_count('aaaaa', 'aa') AS n").first().n == 4
    assert spark.sql("SELECT extract_range('hello', 1, 3) AS s").first().s == "ell"


def test_compressed_files(spark, tmp_path):
    import bz2
    import gzip
    import lzma

    for end, pack in ((".xz", lzma.compress), (".gz", gzip.compress), (".bz2", bz2.compress), (".txt", bytes)):
        (tmp_path / f"t{end}").write_bytes(pack("tgcaacgté\n".encode()))
    assert {r.text for r in sources.compressed_files(spark, str(tmp_path)).collect()} == {"tgcaacgté\n"}
    (tmp_path / "t.txt").write_bytes(b"ab\xff")
    assert "ab\ufffd" in {r.text for r in sources.compressed_files(spark, str(tmp_path)).collect()}


def test_command_line(spark, tmp_path, capsys):
    from glyphgrid.__main__ import main

    (tmp_path / "text.txt").write_bytes(b"tgcaacgt" * 5)
    (tmp_path / "pattern.txt").write_bytes(b"acgt")
    assert main(["cs", "4", str(tmp_path / "text.txt"), str(tmp_path / "index")]) == 0
    capsys.readouterr()
    assert main(["lc", str(tmp_path / "index"), str(tmp_path / "pattern.txt")]) == 0
    assert capsys.readouterr().out.split()[-1] == "5"
    assert main(["xx"]) == 2
    index = TextIndex.load(spark, str(tmp_path / "index"))
    assert [(r.n, r.sigma) for r in index.parameters().collect()] == [(12, 5)]
    assert index.space().count() == sum(len(t.columns) for t in index.tables.values()) + 1


def test_streams(spark, tmp_path):
    """Files that arrive one after another, late rows and windows."""
    from glyphgrid.streaming.counts import drained, running_counts, text_stream, windowed_counts

    for i, text in enumerate(["banana", "ananas", None, ""]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "texts.parquet"))
    stream = text_stream(spark, str(tmp_path), "texts.parquet", per_trigger=1)
    out = drained(running_counts(stream, ["ana", "z"]), "running")
    assert {r.pattern: r.occ for r in out.collect()} == {"ana": 4, "z": 0}

    rows = [("2024-01-01 00:00:10", "aa"), ("2024-01-01 00:00:50", "aaa"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 01:00:00", "aa")]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "ts string, text string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "text").coalesce(1).write.parquet(path)
    events = spark.readStream.schema("ts timestamp, text string").parquet(path)
    table = drained(windowed_counts(events, "ts", "text", ["aa"], "1 minute", "5 minutes"), "windowed", "append")
    assert sorted((str(r.window.start), r.occ) for r in table.collect()) == [("2024-01-01 00:00:00", 3), ("2024-01-01 00:02:00", 0)]
