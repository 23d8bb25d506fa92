"""The pipeline's stages and result, and the registration of queries."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from glyphgrid.llm import secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_effects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = docs.toPandas()
        assert now["doc_id"].is_unique and set(now["doc_id"]) <= set(first["doc_id"])
        assert (now["text"].map(len) == now["n_chars"]).all()
        if name == "language_id":
            assert len(now) == first["text"].str.contains(r"[^\W\d_]").sum()
        if name == "exact_dedup":
            assert len(now) == first["text"].str.replace(r"[\x20\x09-\x0D]+", " ", regex=True).nunique()
        if name == "secret_scan":
            assert not now["text"].str.contains(r"[0-9a-f]{16}").any()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, text in zip(now["doc_id"], now["text"], strict=True):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        part = out[out["doc_id"] == doc].sort_values("start")
        assert part["length"].sum() == len(ids) and len(part)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in part.itertuples())
    assert len(out["doc_id"].unique()) == len(now)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op4_prefix_free_dedup", "op6_exact_dedup", "op9_fm_index_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = __spark_entry__.queries()[name](spark, SF).toPandas()
    other = con.sql(__spark_entry__.oracle_sql()[name]).df()[list(mine.columns)]
    assert sorted(map(tuple, mine.values.tolist())) == sorted(map(tuple, other.values.tolist()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: a held-out row, so that its script isn't learned
OTHER_SCRIPT = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 3 == 1)


def small_corpus():
    """Rows with nulls, empty and letterless texts, repeats, copies, near copies, secrets, other scripts, one text of
    several sequences, and a hot null id."""
    rnd = random.Random(31)
    en = "the of and to in that is was for with as on are by this be at from or an".split()
    de = "der die und zu den das nicht von sie ist des sich mit dem dass er es ein ich auf".split()
    prose = lambda words, n: " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(en if i % 3 else de, rnd.randint(15, 120)), "en" if i % 3 else "de") for i in range(60)]
    base = max((r[1] for r in rows), key=len).split()
    for i in (100, 101):
        words = list(base)
        words[len(words) // 2] = f"changed{i}"
        rows.append((i, " ".join(words), "en"))
    rows += [(110, rows[7][1].replace(" ", "\n\t"), "en"), rows[8], rows[8], (111, None, "en"), (112, "", None), (113, " \n ", "de"), (114, "12 !? 34", "en")]
    rows += [(115, "password = hunter2hunter2 and client_id = app42 at https://api.example.com/v1 for " + prose(en, 30), None), (OTHER_SCRIPT, "доброеутровсемлюдяммиравэтотпрекрасныйдень", "en")]
    rows += [(117, prose(en, 6000), "en"), *[(None, prose(en, 25), None) for _ in range(5)], (None, None, None)]
    return [(i, t, lang, rnd.choice(["a", None]), None if t is None else len(t)) for i, t, lang in rows]


def test_run_against_brute_force(spark, tmp_path):
    rows = small_corpus()
    spark.createDataFrame(rows, SCHEMA).withColumns({"__th": F.lit(1), "__digest": F.lit("x"), "grp": F.lit(2)}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    # language: a letter, and a script that was learned; exact copies: the smallest id (null first) stays
    left, seen = [], set()
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if t and re.search(r"[^\W\d_]", t) and i != OTHER_SCRIPT and key not in seen:
            seen.add(key)
            left.append((i, t))
    # near copies: the first of each class of 5-word sets at 0.8 or more stays
    sets = []
    for _, t in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    parent = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    ids = [x for k, x in enumerate(left) if parent[k] == k or left[parent[k]][0] is None]
    assert len({p for p in parent}) == len(ids) == len(left) - 2
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in ids:
        t = secret_scan.masked(t)
        want[(i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"].dropna().astype(int)) == {i for i, _ in ids if i is not None}
    for i, data in want:
        if i is not None:
            part, n = out[out["doc_id"] == i].sort_values("start"), len(data) // 4
            assert (part["doc_tokens"] == n).all() and part["length"].sum() == n
            assert all(p.ids_crc32 == zlib.crc32(data[4 * int(p.start) : 4 * int(p.start + p.length)]) for p in part.itertuples())
    lost = out[out["doc_id"].isna()]
    assert lost["length"].sum() == sum(len(d) // 4 * n for (i, d), n in want.items() if i is None)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 4096 and (own["offset"].astype(int).to_numpy() == np.cumsum([0, *own["length"].astype(int)])[:-1]).all()


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_up(spark):
    from glyphgrid.llm.common import clean_up, stage

    table = stage(spark.range(5), "small")
    assert table.count() == 5
    clean_up(spark)
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(table.inputFiles()[0]).count()
