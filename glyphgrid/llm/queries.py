"""The op queries: (spark, sf_dir) -> DataFrame, each through its operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfp_dedup import dedup

    return dedup(documents(spark, sf_dir)).drop("uid")


def op5_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .robust_quality import judge

    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .trie_bpe import encode_digests

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_dedup import dedup

    return dedup(documents(spark, sf_dir)).drop("uid")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_html_extract, op3_cost_balanced_packing, op4_prefix_free_dedup, op5_robust_quality, op6_exact_dedup, op7_trie_bpe, op8_secret_scan, op9_fm_index_dedup, op10_language_id)}

WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents)"

ORACLES = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE {WORDS},
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(list_slice(l, i, i + 4), ' '))
      WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a)
SELECT a AS doc_id, min(c) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.a) AS n_links FROM r GROUP BY r.a""",
    "op4_prefix_free_dedup": """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
v AS (SELECT doc_id, i, md5(substr(b, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, b, unnest(range(0, length(b) // 2 - 99)) AS i FROM x WHERE length(b) >= 200)),
d AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
u AS (SELECT doc_id, p, substr(b, 2 * p + 1, 2) AS byte FROM (SELECT doc_id, b, unnest(range(0, length(b) // 2)) AS p FROM x)),
f AS (SELECT u.*, max(CASE WHEN d.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM u LEFT JOIN d ON d.doc_id = u.doc_id AND d.i = u.p),
h AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS head FROM f)
SELECT x.doc_id, length(b) // 2 AS n_bytes, count(*) FILTER (WHERE gone = 1) AS n_removed, count(*) FILTER (WHERE head) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0), ''))) AS kept_sha256
FROM x LEFT JOIN h USING (doc_id) GROUP BY x.doc_id, b""",
    "op9_fm_index_dedup": f"""
WITH {WORDS},
x AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 34), ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM x) WHERE c > 1),
u AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w),
f AS (SELECT u.*, max(CASE WHEN d.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM u LEFT JOIN d ON d.doc_id = u.doc_id AND d.i = u.p)
SELECT w.doc_id, len(l) AS n_words, count(*) FILTER (WHERE gone = 1) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id, len(l)""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d""",
}
