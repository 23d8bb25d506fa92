"""Catalogue: one query for each operator, over whole tables and whole texts, and its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coders
from ..functions.text import size_text, time_text
from ..operators import alphabet, collections, count, factorize, locate, patterns, ranges, stats, suffix
from ..operators.kernels import code_points, lz77, per_text
from ..sources.texts import benchmark, conversations, documents, load_patterns, quarantined, save_patterns, shared_folder
from ..streaming.counts import drained, running_counts, text_stream, windowed_counts
from . import oracle
from .text_index import TextIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PATTERNS = ("the", "ion", "e", "zzzz")
SHORT = ("th", "e", "ion", "an", "zz")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# --- counting -------------------------------------------------------------------------------------------------------


@query(oracle.count_patterns(PATTERNS))
def count_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return count.count_patterns(documents(spark, sf), list(PATTERNS))


@query(oracle.count_per_doc("an"))
def count_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return count.count_per_text(documents(spark, sf), "an")


@query(oracle.overlapping_and_disjoint(("anan", "enen", "ll", "the")))
def count_overlapping_vs_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    return count.overlapping_and_disjoint(documents(spark, sf), ["anan", "enen", "ll", "the"])


@query(oracle.COUNT_BATCH_FIXED)
def count_batch_fixed(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf)
    return count.count_batch(texts, patterns.sample(texts, 12))


@query(oracle.COUNT_BATCH_VARLEN)
def count_batch_varlen(spark: SparkSession, sf: str) -> DataFrame:
    texts = conversations(spark, sf)
    return count.count_batch(texts, patterns.sweep(texts, 0, 6))


@query(oracle.COUNT_ABSENT)
def count_absent_symbol(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(1, "a☃"), (2, "the"), (3, "Жук"), (4, "tion of")], "pattern_id long, pattern string")
    return count.absent_symbols(documents(spark, sf), wanted)


@query(oracle.GRAMS_4)
def gram_counts_4(spark: SparkSession, sf: str) -> DataFrame:
    return count.gram_counts(documents(spark, sf), 4)


@query(oracle.index_count(PATTERNS))
def index_count(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_id long, pattern string")
    return TextIndex.build(documents(spark, sf), 4).count(wanted)


LONGER = ("the", "an ", "of the", "e", "zz☃", "on the", "que ", " in the ")


@query(oracle.index_count(LONGER, oracle.MERGED))
def index_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two indexes merged into one, and patterns of several lengths counted in it."""
    more = benchmark(spark, sf).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    index = TextIndex.build(conversations(spark, sf), 7).merged(TextIndex.build(more, 7))
    return index.count(spark.createDataFrame(list(enumerate(LONGER)), "pattern_id long, pattern string"))


@query(oracle.COUNT_BATCH_FIXED)
def index_count_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern of each document, in the index of all."""
    texts = documents(spark, sf)
    return TextIndex.build(texts, 7).count(patterns.sample(texts, 12))


@query(oracle.index_count(LONGER, oracle.CONVERSATIONS))
def index_saved(spark: SparkSession, sf: str) -> DataFrame:
    """An index that is written, read again and searched."""
    path = f"{shared_folder(spark)}/glyphgrid/index-{uuid.uuid4().hex}"
    TextIndex.build(conversations(spark, sf), 4).save(path)
    return TextIndex.load(spark, path).count(spark.createDataFrame(list(enumerate(LONGER)), "pattern_id long, pattern string"))


@query(oracle.INDEX_PARAMETERS)
def index_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """n', r' and sigma' of each text, from an index."""
    return TextIndex.build(benchmark(spark, sf), 4).parameters()


@query(oracle.SAMPLE)
def pattern_collection(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern collection with its provenance, written and read again."""
    path = f"{shared_folder(spark)}/glyphgrid/patterns-{uuid.uuid4().hex}"
    save_patterns(patterns.sample(documents(spark, sf), 12), path)
    return load_patterns(spark, path)


@query(oracle.PATTERN_FACTORS)
def pattern_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Where factors start inside patterns, under both types of the run that ends them."""
    return factorize.pattern_factors(patterns.sample(documents(spark, sf), 12))


@query(oracle.LAMBDAS)
def lambda_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = [factorize.factors(benchmark(spark, sf), k).select(F.lit(k).cast("long").alias("lambda"), "factor", "len") for k in range(1, 9)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("lambda").agg(F.count("*").alias("blocks"), F.count_distinct("factor").alias("factors"), F.sum("len").alias("chars"))


@query(oracle.count_patterns(LONGER, oracle.CONVERSATIONS))
def csa_count(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.csa_counts(conversations(spark, sf), list(LONGER))


@query(oracle.interval_sizes(("the", "an", "zz")))
def interval_size(spark: SparkSession, sf: str) -> DataFrame:
    texts = conversations(spark, sf)
    found = suffix.backward_search(texts, ["the", "an", "zz"])
    wanted = texts.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("an"), F.lit("zz"))).alias("pattern"))
    size = F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0))
    return wanted.join(found, ["doc_id", "pattern"], "left").select("doc_id", "pattern", size.alias("size"), (size == 0).alias("is_empty"))


@query(oracle.decomposition(SHORT, 7))
def count_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf)
    dictionary = factorize.factor_counts(texts, 7)
    borders = factorize.borders(texts, 7, max(map(len, SHORT)) - 1)
    return count.decomposition(None, dictionary, factorize.sub_factors(dictionary), list(SHORT), 7, borders)


@query(oracle.range_counts(SHORT, prefix=True))
def prefix_range_count(spark: SparkSession, sf: str) -> DataFrame:
    return count.prefix_range_count(factorize.factor_counts(documents(spark, sf), 4), list(SHORT))


@query(oracle.range_counts(SHORT, prefix=False))
def suffix_range_count(spark: SparkSession, sf: str) -> DataFrame:
    return count.suffix_range_count(factorize.factor_counts(documents(spark, sf), 4), list(SHORT))


@query(oracle.DIFF_CHECK)
def diff_check(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways to count the same patterns, compared: mismatches and rows."""
    texts = conversations(spark, sf)
    wanted = patterns.sample(texts, 6)
    one = count.broadcast_batch(texts, wanted)
    grams = count.gram_counts(texts, 6)
    other = wanted.join(grams, wanted["pattern"] == grams["gram"], "left").select("pattern_id", F.coalesce("cnt", F.lit(0)).alias("other"))
    return one.join(other, "pattern_id", "full").agg(F.count_if(~F.col("occ").eqNullSafe(F.col("other"))).alias("mismatches"), F.count("*").alias("total"), F.sum("occ").alias("one"), F.sum("other").alias("other"))


@query(oracle.count_patterns(PATTERNS))
def streaming_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = text_stream(spark, sf, "documents.parquet")
    return drained(running_counts(stream, list(PATTERNS)), "streaming_counts")


@query(oracle.STREAM_WINDOWS)
def streaming_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in event-time windows of a day, from a stream of events."""
    events = text_stream(spark, sf, "events.parquet", schema="ts timestamp, props string")
    table = drained(windowed_counts(events, "ts", "props", ["1", "7"], "1 day", "1 day"), "streaming_windows", "complete")
    return table.select(F.col("window.start").alias("start"), "pattern", "occ")


@query("SELECT count(*) FILTER (WHERE doc_id % 10 <> 0) AS good, count(*) FILTER (WHERE doc_id % 10 = 0) AS held FROM documents")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a NUL (put into every tenth here) are held back."""
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    good, held = quarantined(documents(spark, sf).withColumn("text", text))
    return good.agg(F.count("*").alias("good")).crossJoin(held.agg(F.count("*").alias("held")))


# --- locating -------------------------------------------------------------------------------------------------------


@query(oracle.locate("anan"))
def locate_positions(spark: SparkSession, sf: str) -> DataFrame:
    return locate.locate(documents(spark, sf), "anan")


@query(oracle.locate("anan", 2))
def locate_first_k(spark: SparkSession, sf: str) -> DataFrame:
    return locate.locate(documents(spark, sf), "anan", 2)


@query("SELECT doc_id, substr(text, CAST(length(text) // 2 AS BIGINT) + 1, 20) AS part FROM documents")
def extract_range(spark: SparkSession, sf: str) -> DataFrame:
    return locate.extract_range(documents(spark, sf), F.floor(F.length("text") / 2), F.lit(20))


@query(oracle.display_context("anan", 10))
def display_context(spark: SparkSession, sf: str) -> DataFrame:
    return locate.display_context(documents(spark, sf), "anan", 10)


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def doc_listing(spark: SparkSession, sf: str) -> DataFrame:
    return locate.doc_listing(documents(spark, sf), "License")


@query(oracle.doc_counts(("License", "token", "zzzz", "e")))
def doc_count(spark: SparkSession, sf: str) -> DataFrame:
    return locate.doc_counts(documents(spark, sf), ["License", "token", "zzzz", "e"])


@query(oracle.LISTING_RUNS)
def doc_listing_rle(spark: SparkSession, sf: str) -> DataFrame:
    return locate.listing_runs(locate.doc_listing(documents(spark, sf), "the"))


@query(oracle.CONTAINMENT)
def passage_containment(spark: SparkSession, sf: str) -> DataFrame:
    return locate.containment(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


# --- alphabet and factorisation -------------------------------------------------------------------------------------


@query(oracle.SYMBOL_TABLE)
def symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    return alphabet.symbol_table(documents(spark, sf))


@query(oracle.ENCODE)
def encode_text(spark: SparkSession, sf: str) -> DataFrame:
    return alphabet.encoded(conversations(spark, sf))


@query(oracle.TEXT_PARAMS)
def text_params_n_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return alphabet.text_params(documents(spark, sf))


@query(oracle.WIDTH)
def effective_width(spark: SparkSession, sf: str) -> DataFrame:
    return alphabet.text_params(documents(spark, sf)).select("doc_id", alphabet.width(F.col("sigma")).alias("width"))


@query(oracle.SL_TYPES)
def sl_types(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.sl_types(conversations(spark, sf))


@query(oracle.LMS)
def lms_positions(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.lms(conversations(spark, sf))


@query(oracle.SL_FACTORS)
def sl_factors(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.sl_factors(conversations(spark, sf))


for _lam in range(1, 9):
    query(oracle.factors(_lam), f"factors_lambda{_lam}")(lambda spark, sf, lam=_lam: factorize.factors(conversations(spark, sf), lam))


@query(oracle.LEX_DICTIONARY)
def lex_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.ranked(factorize.factor_counts(documents(spark, sf), 4))


@query(oracle.COLEX_DICTIONARY)
def colex_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.colex_dictionary(factorize.ranked(factorize.factor_counts(documents(spark, sf), 4)))


@query(oracle.LEX_TEXT)
def lex_text(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.lex_text(factorize.factors(conversations(spark, sf), 4))


@query(oracle.SUB_FACTORS)
def sub_factor_counts(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.sub_factors(factorize.factor_counts(documents(spark, sf), 7))


@query(oracle.TRIE_DEPTH)
def sub_factor_trie_depth(spark: SparkSession, sf: str) -> DataFrame:
    inner = factorize.sub_factors(factorize.factor_counts(documents(spark, sf), 7))
    return inner.groupBy(F.length("sub").cast("long").alias("depth")).agg(F.count("*").alias("nodes"))


@query(oracle.INDEX_PARAMS)
def index_params(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.index_params(documents(spark, sf), 4).select("doc_id", "n", "sigma")


@query(oracle.INDEX_RUNS)
def index_bwt_runs(spark: SparkSession, sf: str) -> DataFrame:
    return factorize.index_params(benchmark(spark, sf), 4).select("doc_id", "r")


# --- suffix order ---------------------------------------------------------------------------------------------------


@query(oracle.suffixes("doc_id, row, pos"))
def suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.suffix_table(conversations(spark, sf)).select("doc_id", "row", "pos")


@query(oracle.suffixes("doc_id, pos, row AS rank"))
def inverse_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.suffix_table(conversations(spark, sf)).select("doc_id", "pos", F.col("row").alias("rank"))


@query(oracle.suffixes("doc_id, row, ch"))
def bwt(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.suffix_table(conversations(spark, sf)).select("doc_id", "row", "ch")


@query("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")
def inverse_bwt(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.inverse_bwt(suffix.bwt_texts(conversations(spark, sf)))


@query(oracle.BWT_RUNS_R)
def bwt_runs_r(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.bwt_run_counts(conversations(spark, sf))


@query(oracle.BWT_RUNS)
def bwt_run_table(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.bwt_runs(conversations(spark, sf))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """For each text and a few symbols: a row in its middle and a number of occurrence."""
    rows = conversations(spark, sf).select("doc_id", F.floor((F.length("text") + 1) / 2).alias("at"), F.lit(3).cast("long").alias("k"))
    return rows.select("*", F.explode(F.array(*[F.lit(c) for c in "eta"])).alias("ch"))


@query(oracle.RANK)
def rank_query(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.rank(conversations(spark, sf), asked(spark, sf).drop("k"))


@query(oracle.SELECT)
def select_query(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.select(conversations(spark, sf), asked(spark, sf).drop("at"))


@query(oracle.LF)
def lf_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.lf_mapping(conversations(spark, sf))


@query(oracle.PSI)
def psi_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.psi_mapping(conversations(spark, sf))


@query(oracle.INVERSE_SELECT)
def wt_inverse_select(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol at every fifth row of the BWT and its rank there, from a wavelet matrix for each text."""
    return suffix.inverse_select(conversations(spark, sf), 5, 3)


@query(oracle.lex_intervals(("the", "an", "que")))
def backward_search(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.backward_search(conversations(spark, sf), ["the", "an", "que"])


@query(oracle.lex_intervals(("the", "an", "que")))
def lex_interval(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.lex_intervals(conversations(spark, sf), ["the", "an", "que"])


@query(oracle.LCP)
def lcp_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.lcp_array(benchmark(spark, sf))


@query(oracle.LONGEST)
def longest_repeated_substring(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.longest_repeats(benchmark(spark, sf))


@query(oracle.PLCP)
def plcp_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.plcp_array(benchmark(spark, sf))


@query(oracle.suffixes("doc_id, row, pos") + " WHERE row % 16 = 0")
def sampled_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.sampled_suffix_array(suffix.suffix_table(conversations(spark, sf)), 16)


@query(oracle.SUFFIX_TREE)
def suffix_tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.suffix_tree(benchmark(spark, sf)).select("doc_id", "depth", "lo", "hi")


@query(oracle.TREE_DEGREES)
def suffix_tree_children(spark: SparkSession, sf: str) -> DataFrame:
    """Inner children of each node, by its rows."""
    tree = suffix.suffix_tree(benchmark(spark, sf))
    up = tree.where("node <> parent").groupBy("doc_id", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    return tree.join(up, ["doc_id", "node"]).select("doc_id", "lo", "hi", "children")


@query(oracle.TREE_LINKS)
def suffix_tree_links(spark: SparkSession, sf: str) -> DataFrame:
    """The suffix link of each inner node: the node of its string without the first character."""
    return suffix.suffix_links(benchmark(spark, sf))


@query(oracle.TREE_PARENTS)
def suffix_tree_parents(spark: SparkSession, sf: str) -> DataFrame:
    tree = suffix.suffix_tree(benchmark(spark, sf))
    up = tree.select("doc_id", F.col("node").alias("parent"), F.col("depth").alias("parent_depth"))
    return tree.where("node <> parent").join(up, ["doc_id", "parent"]).select("doc_id", "lo", "hi", "parent_depth", (F.col("hi") - F.col("lo") + 1).alias("leaves"))


@query(oracle.TREE_LEAVES)
def suffix_tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The parent of each leaf, and the leaf's place among the leaves below it."""
    return suffix.leaf_parents(benchmark(spark, sf))


@query(oracle.LCA)
def suffix_tree_lca(spark: SparkSession, sf: str) -> DataFrame:
    texts = benchmark(spark, sf)
    pairs = texts.select("doc_id", F.lit(5).cast("long").alias("a"), F.explode(F.sequence(F.lit(6).cast("long"), F.lit(40).cast("long"))).alias("b"))
    return suffix.lowest_common_ancestors(suffix.suffix_tree(texts), pairs)


@query(oracle.suffixes("doc_id, pos AS row, row AS pos"))
def inverse_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return collections.inverse_permutation(suffix.suffix_table(conversations(spark, sf)), "doc_id", "row", "pos")


@query()
def lz77_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: a greedy parse is sequential. Tests decode it again."""

    def kernel(text: str) -> dict:
        start, source, size = lz77(code_points(text))
        return {"start": start, "source": source, "len": size}

    return per_text(conversations(spark, sf), "doc_id long, start long, source long, len long", kernel)


# --- ranges ---------------------------------------------------------------------------------------------------------


def middle(spark: SparkSession, sf: str) -> DataFrame:
    """BWT rows of each text in the second and third quarter, with n."""
    return suffix.middle_rows(conversations(spark, sf))


@query(oracle.RANGE_2D)
def range_count_2d(spark: SparkSession, sf: str) -> DataFrame:
    rows = middle(spark, sf)
    n = F.col("n")
    return ranges.range_count_2d(rows, "doc_id", "row", "pos", (F.floor(n / 3), F.floor(n / 2), F.lit(0), F.floor(n / 2)))


@query(oracle.QUANTILE)
def wt_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.quantile(middle(spark, sf), "doc_id", ["ch", "row"], F.lit(10), "ch")


@query(oracle.INTERVAL_SYMBOLS)
def wt_interval_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.interval_symbols(middle(spark, sf), "doc_id", "ch")


@query(oracle.LEX_COUNT)
def wt_lex_count(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.lex_count(middle(spark, sf), "doc_id", "ch", F.lit("m"))


@query(oracle.INTERSECT)
def wt_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that both the first and the second turn of a conversation have in their ranges."""
    rows = middle(spark, sf).withColumn("conv_id", F.floor(F.col("doc_id") / 1000)).withColumn("turn", F.pmod("doc_id", F.lit(1000)))
    return ranges.intersect(rows.where("turn = 0"), rows.where("turn = 1"), ["conv_id", "ch"])


@query(oracle.UNIQUE_RANGE)
def wt_unique_range(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct symbols of a range of rows that are in a range of symbols."""
    rows = middle(spark, sf).where((F.col("ch") >= "d") & (F.col("ch") < "p"))
    return ranges.interval_symbols(rows, "doc_id", "ch").select("doc_id", "ch")


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS weight, count(*) AS n FROM lineitem WHERE l_partkey BETWEEN 10 AND 1500 AND l_suppkey BETWEEN 5 AND 80 GROUP BY 1")
def weighted_range_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_partkey").between(10, 1500) & F.col("l_suppkey").between(5, 80))
    return rows.groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("weight"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 10 AND 1500 AND l_suppkey BETWEEN 5 AND 80 AND l_linenumber BETWEEN 2 AND 4")
def range_search_3d(spark: SparkSession, sf: str) -> DataFrame:
    box = F.col("l_partkey").between(10, 1500) & F.col("l_suppkey").between(5, 80) & F.col("l_linenumber").between(2, 4)
    return spark.read.parquet(f"{sf}/lineitem.parquet").where(box).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query('SELECT l_suppkey AS node, count(*) AS degree, min(l_partkey) AS "first", max(l_partkey) AS "last" FROM lineitem GROUP BY 1')
def graph_reverse_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Along edges part-supplier, from the supplier's side."""
    return ranges.neighbours(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_suppkey", "l_partkey")


@query(oracle.PRED_SUCC)
def symbol_pred_succ(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.pred_succ(alphabet.text_symbols(documents(spark, sf)), "doc_id", "ch", ["B", "h", "~"])


@query(oracle.RMQ)
def rmq(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    wanted = events.where("event_id % 97 = 0").select(F.col("event_id").alias("range_id"), F.col("event_id").alias("l"), (F.col("event_id") + 1499).alias("r"))
    return ranges.range_minimum(events, "event_id", "value", wanted)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_partkey BETWEEN 10 AND 1500 AND l_suppkey BETWEEN 5 AND 80 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topk_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranges.top_k(rows, F.col("l_partkey").between(10, 1500) & F.col("l_suppkey").between(5, 80), "l_extendedprice", ["l_orderkey", "l_linenumber"], 10)


@query('SELECT o_custkey AS node, count(*) AS degree, min(o_orderkey) AS "first", max(o_orderkey) AS "last" FROM orders GROUP BY 1')
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.neighbours(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 400 AND o_orderkey BETWEEN 50 AND 900")
def graph_range(spark: SparkSession, sf: str) -> DataFrame:
    return collections.edges_in_box(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", "o_orderkey", (100, 400, 50, 900))


@query(oracle.NEAREST)
def nearest_in_order(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    values = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("v"))
    return collections.neighbours_in_order(values, spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("q")))


@query(oracle.OFFSETS)
def collection_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return collections.collection_offsets(documents(spark, sf))


@query(oracle.OWNERS)
def sequence_of_position(spark: SparkSession, sf: str) -> DataFrame:
    offsets = collections.collection_offsets(documents(spark, sf))
    asked = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * 13).alias("pos")).distinct()
    return collections.owners(offsets, asked)


@query("SELECT c_custkey AS a, c_custkey + 1 AS b, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = c_custkey + 1) AS is_edge FROM customer")
def graph_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return ranges.adjacent(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", "o_orderkey", pairs)


# --- patterns, generators, reports ----------------------------------------------------------------------------------


@query(oracle.SAMPLE)
def pattern_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.sample(documents(spark, sf), 12)


@query(oracle.SWEEP)
def pattern_length_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.sweep(documents(spark, sf), 0, 8)


@query(oracle.MUTATION)
def pattern_mutation(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.mutated(patterns.sample(documents(spark, sf), 12)).select("pattern_id", "swap_l", "swap_r", "mutant")


@query(oracle.DNA)
def repetitive_dna(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.repetitive_dna(spark, 5000, 6, 3, 42)


@query("SELECT doc_id, left(text, 40) AS prefix FROM documents")
def prefix_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.prefixes(documents(spark, sf), 40)


@query(oracle.SIZE_FORMAT)
def size_format(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("long") * F.col("doc_id")
    return documents(spark, sf).select("doc_id", size_text(size).alias("size"), time_text((size * F.lit(1000) + 7).cast("double")).alias("time"))


@query(oracle.CODES)
def integer_codes(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey") + 1
    gamma = coders.elias_gamma(x)
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    return rows.select(x.alias("x"), coders.width(x).alias("width"), coders.ones(x).alias("ones"), gamma.alias("gamma"), coders.elias_delta(x).alias("delta"), coders.elias_gamma_value(gamma).alias("back"))


@query("WITH d AS (SELECT o_orderkey + 1 AS x, to_base(o_orderkey + 1, 3) AS d FROM orders) SELECT x, replace(replace(replace(replace(replace(d, '2', 'b'), '1', 'a'), '0', '00'), 'a', '01'), 'b', '10') || '11' AS code FROM d")
def comma_codes(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey") + 1
    return spark.read.parquet(f"{sf}/orders.parquet").select(x.alias("x"), coders.comma(x).alias("code"))


@query()
def fibonacci_codes(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: the greedy digits are sequential. Tests decode them."""
    x = F.col("o_orderkey") + 1
    return spark.read.parquet(f"{sf}/orders.parquet").select(x.alias("x"), coders.fibonacci(x).alias("code"))


@query(oracle.SPACE)
def space_report(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = factorize.ranked(factorize.factor_counts(documents(spark, sf), 4))
    return stats.space_report({"texts": documents(spark, sf), "dictionary": dictionary, "alphabet": alphabet.symbol_table(documents(spark, sf))})


@query(oracle.ENTROPY)
def hk_entropy(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf)
    return stats.entropy(texts, 0).unionByName(stats.entropy(texts, 1)).unionByName(stats.entropy(texts, 2))
