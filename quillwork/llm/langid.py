"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over windows of bytes; the greatest response of each
filter and the window's bias go to a softmax over languages. The bytes are one-hot, so
a filter is a table of weights by its offset and byte, and a response is a sum of
looked-up rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import column_bytes, slices

#: Widths of the filters, and filters of each width.
WIDTHS, FILTERS = (2, 4, 6), 16
#: Bytes of a window, and how far apart windows start: every run of the widest filter lies in one.
WINDOW, STEP = 128, 128 - max(WIDTHS) + 1
#: Texts that the network is fitted on, at most of each language, and windows of each text.
FIT_TEXTS, FIT_WINDOWS = 1500, 4
#: Languages that are learned, at most: the most frequent ones.
FIT_LANGUAGES = 1000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.01, 1e-5
SEED = 11
UNKNOWN = "und"
#: The remainder of a document's checksum by 4 that is held out.
HELD_OUT = 2

#: Symbols: 0 for what is no letter, 1 to 26 for A-Z in either case, and each byte of other letters.
_SYMBOL = np.zeros(256, np.int16)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
SYMBOLS = 155
#: Windows whose responses are computed together.
_TOGETHER = 4096


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every text and their offsets; runs of bytes that are no letters are one, and each text starts with one."""
    s = _SYMBOL[data]
    keep = (s > 0) | np.append(True, s[:-1] > 0)[: len(s)]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    at = total[offsets]
    return np.insert(s[keep], at[:-1], 0), at + np.arange(len(at))


def windows(sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every text as a column of symbols, its text, and how many symbols are its own; a text has one at least."""
    size = np.diff(at)
    many = np.maximum(1, -(-(size - max(WIDTHS) + 1) // STEP))
    row = np.repeat(np.arange(len(size)), many)
    start = at[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    own = np.minimum(WINDOW, at[1:][row] - start)
    padded = np.append(sym, np.zeros(WINDOW, sym.dtype))
    place = start + np.arange(WINDOW)[:, None]
    out = padded[place]
    out[np.arange(WINDOW)[:, None] >= own] = 0
    return out, row, own


@dataclass
class Network:
    """``tables[i][k, s]`` are the weights of the filters of width i for symbol s at offset k."""

    languages: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.pairs = [[(t[k][:, None] + t[k + 1][None]).reshape(-1, t.shape[2]) for k in range(0, len(t), 2)] for t in self.tables]

    def pooled(self, sym: np.ndarray) -> np.ndarray:
        """The greatest response of each filter in each window (a column of ``sym``)."""
        out = []
        for s in range(0, sym.shape[1], _TOGETHER):
            part = sym[:, s : s + _TOGETHER].astype(np.int32)
            pair = part[:-1] * SYMBOLS + part[1:]
            best = []
            for rows in self.pairs:
                top = None
                for t in range(WINDOW - 2 * len(rows) + 1):
                    found = rows[0][pair[t]]
                    for k in range(1, len(rows)):
                        found += rows[k][pair[t + 2 * k]]
                    top = found if top is None else np.maximum(top, found, out=top)
                best.append(top)
            out.append(np.concatenate(best, axis=1))
        return np.concatenate(out) if out else np.zeros((0, len(self.shift)), np.float32)

    def probabilities(self, sym: np.ndarray) -> np.ndarray:
        return self.softmax(np.maximum(self.pooled(sym) + self.shift, 0))

    def softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden.astype(np.float64) @ self.dense + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(sym: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the class-balanced log loss of windows; only the place of a filter's greatest response is moved."""
    rng = np.random.default_rng(seed)
    wide = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
    n, k, hidden = len(label), len(languages), FILTERS * len(WIDTHS)
    rest = [np.zeros(hidden, np.float32), rng.normal(0, 0.1, (hidden, k)), np.zeros(k)]
    theta = [*wide, *rest]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    weight = (n / k) / np.maximum(np.bincount(label, minlength=k), 1)[label] if n else label
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            on = order[s : s + BATCH]
            net = Network(languages, theta[: len(WIDTHS)], *theta[len(WIDTHS) :])
            part, m = sym[:, on], len(on)
            where, best = zip(*(_greatest(part, t) for t in net.tables))
            raw = np.concatenate(best, axis=1) + net.shift
            h = np.maximum(raw, 0)
            slope = net.softmax(h)
            slope[np.arange(m), label[on]] -= 1
            slope *= (weight[on] / m)[:, None]
            back = (slope @ net.dense.T) * (raw > 0)
            grads: list[np.ndarray] = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(theta[i])
                mine = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    code = part[where[i] + j, np.arange(m)[:, None]].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    g[j] = np.bincount(code.ravel(), mine.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
                grads.append(g)
            grads += [back.sum(axis=0), h.T.astype(np.float64) @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, (first, second) in zip(theta, grads, moments):
                g = g + DECAY * p
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Network(languages, theta[: len(WIDTHS)], *theta[len(WIDTHS) :])


def _greatest(sym: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of the greatest response of each filter of one width in each window."""
    top = where = None
    for t in range(WINDOW - len(table) + 1):
        found = table[0][sym[t]]
        for k in range(1, len(table)):
            found += table[k][sym[t + k]]
        if top is None:
            top, where = found, np.zeros(found.shape, np.int64)
        else:
            more = found > top
            where[more] = t
            np.maximum(top, found, out=top)
    return where, top


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def sampled_windows(docs: DataFrame, most: int = FIT_TEXTS, each: int = FIT_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their labels and the languages of a sample of labelled texts that are not held out.

    At most ``most`` texts of each language are taken, in the order of a hash of id and
    text, and at most ``each`` windows of a text, evenly spread over the whole of it.
    Texts stay on the executors; the driver gets ``most * each`` windows a language.
    """
    rows = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("turn"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), held_out(docs[id_col]).alias("held"))
    rows = rows.where("not held and lang is not null").where(has_letter("text")).drop("held")
    share = rows.groupBy("lang").agg((F.lit(2.0 * most) / F.count("*")).alias("share")).orderBy("share", "lang").limit(FIT_LANGUAGES)
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod("turn", F.lit(1 << 20)) <= F.col("share") * F.lit(1 << 20))  # about 2 * most a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sym, row, own = windows(*symbols(*column_bytes(part.column("text"))))
                first = np.searchsorted(row, np.arange(part.num_rows))
                many = np.diff(np.append(first, len(row)))
                spread = np.unique(np.concatenate([first + (many - 1) * i // max(each - 1, 1) for i in range(each)]))
                raw = np.ascontiguousarray(sym[:, spread].T.astype(np.uint8))
                yield pa.record_batch([part.column("lang").take(pa.array(row[spread])), part.column("turn").take(pa.array(row[spread])), pa.array([r.tobytes() for r in raw], pa.binary())], ["lang", "turn", "window"])

    got = drawn.select("lang", "turn", "text").mapInArrow(run, "lang string, turn long, window binary").distinct()
    ranked = got.withColumn("nth", F.dense_rank().over(Window.partitionBy("lang").orderBy("turn"))).where(F.col("nth") <= most).drop("nth")
    table = ranked.toArrow().combine_chunks().sort_by([("lang", "ascending"), ("turn", "ascending"), ("window", "ascending")])
    names = sorted(set(table.column("lang").to_pylist()))
    label = np.array([names.index(x) for x in table.column("lang").to_pylist()], np.int64)
    raw = b"".join(table.column("window").to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW).T.astype(np.int16), label, names


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on a bounded sample of ``docs``; None where nothing is labelled."""
    sym, label, names = sampled_windows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return fit(sym, label, names) if len(label) else None


def languages(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the language of the greatest mean probability over all windows.

    A window counts by its symbols. Only the text is looked at.

    Defined cases: a null text, one without letters, and any text where nothing was
    learned, are ``und`` with score 0; very long texts are read whole; of languages
    with equal means the first by name is told; repeated rows each give a row; an
    empty table gives none; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # its size depends on the number of languages alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sym, row, own = windows(*symbols(*column_bytes(part.column("text"))))
                first = np.searchsorted(row, np.arange(part.num_rows))
                total = np.add.reduceat(net.probabilities(sym) * own[:, None], first, axis=0)
                total /= np.add.reduceat(own, first)[:, None]
                best = total.argmax(axis=1)
                known = part.column("known").to_numpy(zero_copy_only=False)
                name = [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.round(np.minimum(total[np.arange(len(best)), best], 1.0), 6), 0.0)
                yield pa.record_batch([part.column("id"), pa.array(name, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("known", has_letter("text"))
    if network is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op13_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their language; what is learned comes from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = languages(docs, trained(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
