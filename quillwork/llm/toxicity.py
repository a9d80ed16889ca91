"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities before it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import free_names, free_prefix
from ._text import mixed, prefix_hash, row_runs, slices, span_hash, word_spans

#: Hashed word features of a model; the weights are all that is sent to the executors.
FEATURE_BITS = 18
#: Labelled rows that the chain is fitted on, at most; the scoring covers every row.
FIT_ROWS = 6000
FOLDS = 4
#: Word starts that are features beside whole words, in bytes.
STEMS = (4, 5)
#: Pseudo-count of the class ratios that scale the features.
SMOOTH = 2.0


def word_features(column: pa.Array, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct word, and every distinct word start of 4 and 5 bytes, of each text."""
    data, starts, ends, rows = word_spans(column)
    prefix = prefix_hash(data)
    keys = []
    for kind, most in enumerate((None, *STEMS)):
        on = slice(None) if most is None else np.flatnonzero(ends - starts > most)
        first, last = starts[on], ends[on] if most is None else starts[on] + most
        bucket = mixed(span_hash(prefix, first, last) + np.uint64(kind)) >> np.uint64(64 - bits)
        keys.append((rows[on].astype(np.uint64) << np.uint64(bits)) | bucket)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def shared_features(row: np.ndarray, bucket: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The features that more than one text has, in 32 bits."""
    shared = np.bincount(bucket, minlength=1 << bits)[bucket] > 1
    return row[shared].astype(np.int32), bucket[shared].astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """A logistic regression over hashed words and a few dense columns."""

    words: np.ndarray
    dense: np.ndarray
    bias: float

    def margin(self, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.words[bucket], minlength=len(dense)) + dense @ self.dense + self.bias


def fit_linear(row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, steps: int = 100, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """Adam on the class-balanced log loss of all rows.

    A feature counts with the log ratio of its shares of both classes, so that words
    of one class lead from the first step; a feature of one row only is left out.
    """
    n1, n0 = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    rows_with = np.bincount(bucket, minlength=width)
    ones = np.bincount(bucket, y[row], minlength=width)
    ratio = np.log((ones + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((rows_with - ones + SMOOTH * n0 / n1) / (n0 + 2 * SMOOTH * n0 / n1))
    on = rows_with[bucket] > 1
    row, bucket = row[on], bucket[on]
    used = np.flatnonzero(rows_with > 1)
    place = np.zeros(width, np.int32)
    place[used] = np.arange(len(used))
    at, value, k = place[bucket], ratio[bucket].astype(np.float32), len(used)
    theta = np.zeros(k + dense.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for t in range(1, steps + 1):
        slope = weight * (_sigmoid(np.bincount(row, value * theta[:k][at], minlength=len(y)) + dense @ theta[k:-1] + theta[-1]) - y)
        grad = np.concatenate([np.bincount(at, value * slope[row], minlength=k), dense.T @ slope, [slope.sum()]])
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    words = np.zeros(width)
    words[used] = theta[:k] * ratio[used]
    return Linear(words, theta[k:-1], float(theta[-1]))


@dataclass
class Chain:
    """Linear models of categories in order; each sees the probabilities of those before it."""

    categories: tuple[str, ...]
    bits: int = FEATURE_BITS
    models: list[Linear] = field(default_factory=list)

    def predict(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        seen = np.zeros((n, 0))
        for model in self.models:
            seen = np.column_stack([seen, _sigmoid(model.margin(row, bucket, seen))])
        return seen


def fit_chain(texts: Sequence[str | None], labels: np.ndarray, categories: tuple[str, ...], bits: int = FEATURE_BITS, folds: int = FOLDS) -> Chain:
    """Fit the chain; what a later model sees of an earlier one is predicted out of fold.

    The earlier probabilities of each row come from a model that has not seen the row,
    as they will for new rows. A category with one class only gets a constant model.
    """
    return fit_features(*word_features(pa.array(texts, pa.large_string()), bits), labels, categories, bits, folds)


def fit_features(row: np.ndarray, bucket: np.ndarray, labels: np.ndarray, categories: tuple[str, ...], bits: int = FEATURE_BITS, folds: int = FOLDS) -> Chain:
    """``fit_chain`` from the features of the texts."""
    row, bucket = shared_features(row, bucket, bits)
    n = len(labels)
    fold = np.arange(n) % folds
    chain, seen = Chain(categories, bits), np.zeros((n, 0))
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        chain.models.append(fit_linear(row, bucket, seen, y, 1 << bits))
        if k + 1 == len(categories):
            break
        out = np.zeros(n)
        for f in range(folds):
            train, test = fold != f, fold == f
            place = np.cumsum(train) - 1
            on = train[row]
            model = fit_linear(place[row[on]], bucket[on], seen[train], y[train], 1 << bits)
            out[test] = _sigmoid(model.margin(row, bucket, seen))[test]
        seen = np.column_stack([seen, out])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], most: int = FIT_ROWS, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (row, bucket) and labels of at most ``most`` labelled texts, half of them from each class of the last category.

    Rows are taken in the order of a hash of their id, so the sample does not depend
    on how the tables are laid out. Labels that repeat an id count by the greatest of
    each category; of documents that repeat one, the text with the least hash counts.
    Rows with a null label and null texts are left out. Texts stay on the executors:
    the driver gets their distinct features, at most ``2**bits`` numbers a text.
    """
    flags = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    flags = flags.withColumn("turn", F.xxhash64("doc_id"))
    parts = [flags.where(F.col(categories[-1]) == v).orderBy("turn", "doc_id").limit(most // 2) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # most rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(chosen, "doc_id")
    one = rows.groupBy("doc_id", "turn", *categories).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    names = ["turn", "doc_id", *categories, "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = word_features(part.column("text"), bits)
                lists = pa.ListArray.from_arrays(pa.array(row_runs(row, part.num_rows).astype(np.int32)), pa.array(bucket.astype(np.int32)))
                yield pa.record_batch([part.column("turn"), pc.cast(part.column("doc_id"), pa.string()), *[pc.cast(part.column(c), pa.float64()) for c in categories], lists], names)

    told = one.select("turn", "doc_id", *categories, F.col("least.text").alias("text")).mapInArrow(run, "turn long, doc_id string, " + "".join(f"`{c}` double, " for c in categories) + "features array<int>")
    got = told.toArrow().combine_chunks().sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    lists = got.column("features").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()) if got.num_rows else 0)
    return row, lists.flatten().to_numpy(), np.column_stack([got.column(c).to_numpy() for c in categories]).reshape(-1, len(categories))


def score_chain(docs: DataFrame, chain: Chain, columns: Sequence[str] = ("doc_id",), text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``columns`` of every row and p_<category> (or another prefix) of each category; whole texts are read."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # 2**bits weights a category, whatever the input
    names = [*columns, *(f"{prefix}{c}" for c in chain.categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                p = model.predict(*word_features(part.column(text), model.bits), part.num_rows)
                yield pa.record_batch([part.column(c) for c in columns] + [pa.array(x) for x in p.T], names)

    text = text_col if text_col in columns else free_names(docs.select(*columns), "text")[0]
    rows = docs.select(*[docs[c] for c in columns], *[docs[text_col].alias(text)] * (text_col not in columns))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, schema + "".join(f", {prefix}{c} double" for c in chain.categories))


CATEGORIES = ("junk", "toxic")
#: A text above this probability is toxic.
TOXIC_FROM = 0.5


def fitted(spark: SparkSession, sf_dir: str) -> Chain:
    """The chain junk -> toxic fitted on a bounded sample of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return fit_features(*labelled_sample(docs, labels, CATEGORIES), CATEGORIES)


def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the probability of each category and whether they are toxic.

    Defined cases: a null or wordless text has only the models' biases and is not
    toxic; repeated rows each give a row; with no labelled rows nothing is toxic;
    an empty table gives no rows; other columns are not looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decided(score_chain(docs, fitted(spark, sf_dir)))


def decided(scored: DataFrame) -> DataFrame:
    return scored.withColumn("toxic", F.col("p_toxic") > TOXIC_FROM)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the chain does not call toxic, with their columns.

    Null, empty and wordless texts are not toxic and stay; very long texts are scored
    whole; each row is judged by its own text, so repeated rows stay or go together; an
    empty table gives none; other columns, whatever their names, are passed on.
    """
    prefix = free_prefix(docs, "p_")
    scored = score_chain(docs, fitted(spark, sf_dir), docs.columns, prefix=prefix)
    return scored.where(F.col(f"{prefix}toxic") <= TOXIC_FROM).select(docs.columns)
