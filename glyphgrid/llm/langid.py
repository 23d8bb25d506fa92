"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 lower-cased characters, hashed to DIMENSIONS cells, over a sample of at most about
TRAIN_PER_LANGUAGE labelled documents of each language (chosen by a hash of doc_id; the bound keeps the fit's work
constant). Counts are summed on the executors; the driver gets them in slices of SLICE cells. The log-probability matrix (cells x languages, float32) has MATRIX_CELLS numbers at most: past
256 languages, cells are halved. It is broadcast, and texts are scored whole in numpy batches. Priors are the shares of all
training documents. The score is the posterior probability of the predicted language.

`accepted_rows` rejects what no learned language fits: texts that are less likely in the best language than under even
odds for all cells, log(1 / cells) an n-gram. Other scripts and noise fall below it; short or mixed texts don't.

Cases: null text, or a text without any letter, gives `und` with score 0. Rows whose lang or text is null don't train.
With no training row at all everything is `und`. Over MOST_LANGUAGES different labels are an error: they aren't languages. Null doc_id: held_out is null and the row doesn't train. Repeated
rows are scored alike; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_PER_LANGUAGE = 4000
#: numbers of the broadcast matrix at most (64 MB), and labels that it has room for with 256 cells
MATRIX_CELLS, MOST_LANGUAGES = 1 << 24, 1 << 16
SLICE = 256
SMOOTHING = 0.5
LETTER = regex.compile(r"\p{L}")
CHARS_AT_ONCE = 1 << 18


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def cells(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of all orders of the texts, order by order, and the position of the text of each. A text
    gets one blank on either side; n-grams never cross texts."""
    padded = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    shift = np.uint64(64 - dimensions.bit_length() + 1)
    found, owners = [], []
    for n in ORDERS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h >> shift)[inside])
        owners.append(owner[: len(h)][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def chunked(texts: list[str]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS_AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


class LanguageModel:
    """languages: sorted labels; weights: float32 (dimensions, languages) of log probabilities; prior: log priors."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.weights, self.prior = languages, weights, prior

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, (texts, languages), and numbers of n-grams of the texts."""
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for start, some in chunked(texts):
            at, owner = cells(some, len(self.weights))
            size[start : start + len(some)] = np.bincount(owner, minlength=len(some))
            for k in range(len(self.languages)):
                total[start : start + len(some), k] = np.bincount(owner, self.weights[at, k], len(some))
        return total, size

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior probabilities, (texts, languages)."""
        return posterior(self.likelihoods(texts)[0] + self.prior)

    def judged(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Predicted languages, and whether they fit better than even odds for all cells."""
        total, size = self.likelihoods(texts)
        fits = total.max(axis=1) >= size * -np.log(len(self.weights))
        return [self.languages[k] for k in posterior(total + self.prior).argmax(axis=1)], fits


def posterior(total: np.ndarray) -> np.ndarray:
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, dimensions: int = DIMENSIONS, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on the documents that aren't held out. per_language bounds the sample (expected size: a hash of doc_id
    against a threshold from exact counts)."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [k for k, _ in counts]
    if not languages:
        return LanguageModel([], np.zeros((dimensions, 0), np.float32), np.zeros(0))
    while dimensions * len(languages) > MATRIX_CELLS and dimensions > 256:
        dimensions //= 2
    known = docs.sparkSession.createDataFrame([(k, i, per_language / n) for i, (k, n) in enumerate(counts)], "lang string, k int, share double")
    draw = (F.xxhash64("doc_id", F.lit("sample")) / F.lit(2.0**64)) + 0.5
    sample = rows.join(F.broadcast(known), "lang").where(draw < F.col("share")).select("text", "k")

    def make():
        def work(batch: pa.RecordBatch):
            texts, label = batch["text"].to_pylist(), np.array(batch["k"].to_pylist(), np.int64)
            for start, some in chunked(texts):
                names, k = np.unique(label[start : start + len(some)], return_inverse=True)
                at, owner = cells(some, dimensions)
                table = np.bincount(k[owner] * dimensions + at, minlength=len(names) * dimensions)
                used = np.flatnonzero(table)
                yield {"k": names[used // dimensions].astype(np.int32), "cell": used % dimensions, "n": table[used]}

        return work

    def sliced(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(SLICE, np.float32)
        own[part["cell"].to_numpy() % SLICE] = part["n"].to_numpy()
        return pd.DataFrame({"k": part["k"].iloc[:1], "slice": part["slice"].iloc[:1], "counts": [own.astype("<f4").tobytes()]})

    found = by_batch(sample, "k int, cell long, n long", make).groupBy("k", "cell").agg(F.sum("n").alias("n")).withColumn("slice", F.expr(f"int(cell div {SLICE})"))
    table = np.zeros((len(languages), -(-dimensions // SLICE), SLICE), np.float32)
    for r in found.groupBy("k", "slice").applyInPandas(sliced, "k int, slice int, counts binary").collect():
        table[r["k"], r["slice"]] = np.frombuffer(r["counts"], "<f4")
    weights = np.empty((dimensions, len(languages)), np.float32)
    for k, counts_of in enumerate(table):
        own = counts_of.reshape(-1)[:dimensions] + SMOOTHING
        weights[:, k] = np.log(own / own.sum(dtype=float))
    prior = np.log(np.array([n for _, n in counts]) / sum(n for _, n in counts))
    return LanguageModel(languages, weights, prior)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))

    def make():
        own = LanguageModel(*shared.value)

        def work(batch: pa.RecordBatch):
            texts = batch["text"].to_pylist()
            usable = [i for i, t in enumerate(texts) if t is not None and own.languages and LETTER.search(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if usable:
                p = own.scores([texts[i] for i in usable])
                for i, k, s in zip(usable, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = own.languages[k], float(s)
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score}

        return work

    return by_batch(docs.select("doc_id", held_out().alias("held_out"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", make)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def accepted_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text has a letter and fits a learned language; a null lang becomes the
    predicted one. Without any learned language only texts without a letter go."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))
    names = docs.columns

    def make():
        own = LanguageModel(*shared.value)

        def work(batch: pa.RecordBatch):
            texts, lang = batch["text"].to_pylist(), batch["lang"].to_pylist()
            good = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
            if own.languages and good:
                found, fits = own.judged([texts[i] for i in good])
                for i, k in zip(good, found, strict=True):
                    lang[i] = k if lang[i] is None else lang[i]
                good = [i for i, f in zip(good, fits, strict=True) if f]
            columns = dict(zip(names, batch.columns, strict=True)) | {"lang": pa.array(lang, batch["lang"].type)}
            yield {k: c.take(pa.array(good, pa.int32())) for k, c in columns.items()}

        return work

    return by_batch(docs, docs.schema, make)
