"""Quality rules: base statistics and robust multivariate outliers, in DataFrame functions only.

Base statistics of a text (null: none) are expressions of the text alone. The outlier rule estimates, for each language
and source, the minimum-covariance-determinant centre and covariance of transformed statistics. Each group has two
starts, coordinate medians with quartiles and the plain mean with variances; from each, concentration steps (keep the H
share of smallest distances, take its mean and covariance) go on for LEAST_STEPS, and on until no group's determinant falls by
more than SETTLED in its logarithm, or for MOST_STEPS: cuts are approximate quantiles, whose noise never quite settles. The start with the smaller determinant wins, and one reweighting step follows. A document is
rejected if its squared Mahalanobis distance is over CUTOFF, the chi-square quantile for one false rejection in a million
normal rows.

Everything over rows is partial aggregation (a group with a third of all rows meets nowhere); what is joined back is
one row for each group, and the planner broadcasts it only while it is small. Covariances have a floor on the diagonal (the
regularised form of the estimate, whose steps never raise the determinant either), so a statistic that is constant in most of a
group neither makes it singular nor rejects by tiny deviations.

Cases: null or empty text has no words and fails the base rule. A null language or source is a group of its own. Groups
with fewer than LEAST rows that pass the base rule are judged together with the other such groups of their language; if
these are fewer than LEAST too, by a fit of all rows of the language, and if those are, by a fit of all rows of the table
(with fewer than LEAST rows in all there is no fit, and the base rule alone decides). Repeated rows count and are returned each. An empty
table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage

# Fixed values of the base rule.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = r"[#*$%&|<>]+"

#: share of a group's rows that a concentration step keeps, and the factor that makes its covariance consistent for
#: the normal distribution in five dimensions: H / P(chi2_7 <= 6.626), 6.626 being the H quantile of chi2_5
H, CONSISTENT = 0.75, 1.41
LEAST_STEPS, MOST_STEPS, SETTLED = 8, 10, 0.01
#: quantiles of chi2_5: reweighting takes the rows within the one of 0.975; rejected are those over the one of 1 - 1e-6
REWEIGHT, CUTOFF = 12.83, 35.89
LEAST = 50
#: groups up to which their estimates are broadcast (about 25 numbers each); beyond, Spark joins them by shuffle
BROADCAST_GROUPS = 100_000
#: standard deviations that a statistic is at least taken to have, in the order of `transformed`
FLOORS = (0.6, 0.12, 0.25, 0.35, 0.35)
NAMES = tuple(f"x{i}" for i in range(len(FLOORS)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside a lambda, a plain expression would be worked out for each element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words found twice or more. Window hashes rule out most texts; where two are equal the
    windows themselves are compared."""

    def exact(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i")))

        def starts(s: Column) -> Column:
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == s[j]["g"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["g"] == s[j]["g"])))
            return F.array_sort(F.transform(again, lambda j: s[j]["i"]))

        def covered(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.when(b.isNull(), WINDOW).otherwise(F.least(b - a, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        return let(F.array_sort(grams), lambda s: let(starts(s), covered))

    hashed = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))
    some = let(hashed, lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when(n < WINDOW, F.lit(0)).otherwise(F.when(some, exact(words)).otherwise(F.lit(0)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = F.coalesce("text", F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words, n).cast("long").alias("n_repeat_words"))

    def duplicates(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    rows = docs.select("doc_id", "lang", "source", text.alias("t"))
    rows = rows.select(
        "doc_id", "lang", "source",
        let(F.array_remove(F.split("t", SPACES), ""), of).alias("w"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), duplicates).alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def transformed(rows: DataFrame) -> DataFrame:
    """x0..: log words, log mean word length, log shares of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    made = (F.log(n), F.log(chars / n), F.log1p(50 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(10 * F.col("n_repeat_words") / n))
    return rows.select("*", *[x.alias(k) for k, x in zip(NAMES, made, strict=True)])


def joinable(groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(groups) if few else groups


#: whose rows a group holds: one language and source, small sources of a language, a language, all
OWN, SMALL, WIDE, ALL = range(4)
BY = ("g_kind", "g_lang", "g_source")


def keys(df: DataFrame) -> DataFrame:
    """df with the group of each row; null languages and sources have a mark of their own before all that have a name."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return df.withColumns({"g_kind": F.lit(OWN), "g_lang": named("lang"), "g_source": named("source")})


def distances(rows: DataFrame, fit: DataFrame, few: bool, *by: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to the fit of their group (null without one)."""
    joined = rows.join(joinable(fit, few), [*BY, *by], "left")
    terms = [f"{1 if i == j else 2} * p{i}{j} * ({NAMES[i]} - m{i}) * ({NAMES[j]} - m{j})" for i in range(len(NAMES)) for j in range(i + 1)]
    return joined.select(*rows.columns, F.expr(" + ".join(terms)).alias("d2"))


def precision(moments: DataFrame, factor: float, *by: str) -> DataFrame:
    """From n, s_i and s_ij of groups: centre m_i, precision p_ij of factor * covariance plus the floors, and logdet, the
    logarithm of that covariance's determinant."""
    d = range(len(NAMES))
    lower = [(i, j) for i in d for j in range(i + 1)]

    def less(terms: list[str]) -> str:
        return "".join(f" - {t}" for t in terms)

    # one select, in which each column may use those before it: covariance c, Cholesky factor l of it, inverse r of l, r^T r
    made = {f"m{i}": f"s{i} / n" for i in d}
    made |= {f"c{i}{j}": f"{factor}D * (s{i}{j} / n - m{i} * m{j})" + (f" + {FLOORS[i] ** 2}D" if i == j else "") for i, j in lower}
    for j in d:
        made[f"l{j}{j}"] = f"sqrt(greatest(c{j}{j}{less([f'l{j}{k} * l{j}{k}' for k in range(j)])}, {FLOORS[j] ** 2 / 4}D))"
        made |= {f"l{i}{j}": f"(c{i}{j}{less([f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j}" for i in d if i > j}
    for i, j in lower:
        made[f"r{i}{j}"] = f"1 / l{i}{i}" if i == j else f"(0{less([f'l{i}{k} * r{k}{j}' for k in range(j, i)])}) / l{i}{i}"
    made |= {f"p{i}{j}": " + ".join(f"r{k}{i} * r{k}{j}" for k in d if k >= i) for i, j in lower}
    made["logdet"] = " + ".join(f"2 * ln(l{j}{j})" for j in d)
    fit = moments.selectExpr(*by, *[f"{x} AS {name}" for name, x in made.items()])
    return fit.select(*by, *[f"m{i}" for i in d], *[f"p{i}{j}" for i, j in lower], "logdet")


def starts(rows: DataFrame) -> DataFrame:
    """Two starts for each group with LEAST rows or more: medians and quartiles, means and variances."""
    d = range(len(NAMES))
    moments = [F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, x in enumerate(NAMES)] + [f(x).alias(f"{k}{i}") for i, x in enumerate(NAMES) for k, f in (("a", F.avg), ("v", F.var_pop))]
    found = rows.groupBy(*BY).agg(F.count("*").alias("n"), *moments).where(F.col("n") >= LEAST)
    made = []
    for start in (0, 1):
        centre = [F.col(f"a{i}") if start else F.col(f"q{i}")[1] for i in d]
        spread = [F.greatest(F.sqrt(f"v{i}") if start else (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in d]
        shape = [(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i in d for j in range(i + 1)]
        made.append(F.struct(F.lit(start).alias("start"), *[c.alias(f"m{i}") for i, c in enumerate(centre)], *shape, F.lit(float("inf")).alias("logdet")))
    return found.select(*BY, F.explode(F.array(*made)).alias("s")).select(*BY, "s.*")


def fitted(rows: DataFrame, few: bool) -> DataFrame:
    """MCD centre and precision of each group with LEAST rows or more."""
    d = range(len(NAMES))
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}{j}") for i in d for j in range(i + 1)]]
    by = [*BY, "start"]
    fit = stage(starts(rows), "mcd")
    twice = rows.select(*BY, *NAMES, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    for step in range(1, MOST_STEPS + 1):
        near = distances(twice, fit, few, "start").where(F.col("d2").isNotNull())
        cut = near.groupBy(*by).agg(F.percentile_approx("d2", H, 2000).alias("cut"))
        near = near.join(joinable(cut, few), by).where(F.col("d2") <= F.col("cut"))
        now = stage(precision(near.groupBy(*by).agg(*sums), CONSISTENT, *by), "mcd")
        if step >= LEAST_STEPS:
            fall = now.join(joinable(fit.select(*by, F.col("logdet").alias("before")), few), by).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        fit = now
        if step >= LEAST_STEPS and (fall is None or fall <= SETTLED):
            break
    best = fit.groupBy(*BY).agg(F.min_by(F.struct(*[c for c in fit.columns if c not in BY]), F.struct("logdet", "start")).alias("s")).select(*BY, "s.*").drop("start")
    near = distances(rows, stage(best, "mcd"), few).where(F.col("d2") <= REWEIGHT)
    return stage(precision(near.groupBy(*BY).agg(*sums), 1.0, *BY), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, base statistics, base_failed, d2 and kept of every row."""
    rows = stage(keys(transformed(statistics(docs))), "quality", scan=True)
    few = rows.select(*BY).distinct().count() <= BROADCAST_GROUPS
    counts = rows.groupBy(*BY).agg(F.count_if(~F.col("base_failed")).alias("n"))
    small = stage(counts.where(F.col("n") < LEAST), "small")
    # languages whose small groups are too few even together; wide: with their large groups too
    rest = small.groupBy("g_lang").agg(F.sum("n").alias("n")).where(F.col("n") < LEAST).select("g_lang")
    rest = stage(rest.join(counts, "g_lang").groupBy("g_lang").agg((F.sum("n") < LEAST).alias("wide")), "rest")
    marked = rows.join(joinable(small, few), list(BY), "left").join(joinable(rest, few), "g_lang", "left")
    kind = F.when(F.col("n").isNull(), OWN).when(F.col("wide").isNull(), SMALL).when(F.col("wide"), ALL).otherwise(WIDE)
    marked = grouped(marked, kind).drop("n", "wide")
    good = ~F.col("base_failed")
    learn = marked.where(good & (F.col("g_kind") < WIDE))
    kinds = {r["wide"] for r in rest.select("wide").distinct().collect()}
    if False in kinds:
        learn = learn.unionByName(grouped(rows.where(good).join(joinable(rest.where(~F.col("wide")).select("g_lang"), few), "g_lang", "left_semi"), F.lit(WIDE)))
    if True in kinds:
        learn = learn.unionByName(grouped(rows.where(good), F.lit(ALL)))
    fit = fitted(learn, few)
    return distances(marked, fit, few).withColumn("kept", good & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).drop(*BY, *NAMES)


def grouped(rows: DataFrame, kind: Column) -> DataFrame:
    """rows with the group of that kind: the source counts in OWN alone, the language in all but ALL."""
    rows = rows.withColumn("g_kind", kind)
    return rows.withColumns({"g_source": F.when(F.col("g_kind") == OWN, F.col("g_source")).otherwise(""), "g_lang": F.when(F.col("g_kind") == ALL, "").otherwise(F.col("g_lang"))})
