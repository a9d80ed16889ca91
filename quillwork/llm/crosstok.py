"""Alignment of two tokenizers: common cuts, token groups, links, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import stored
from ._text import column_bytes, row_runs, slices

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level vocabularies split a text before merging. A fixed value of their format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a longer run of white space are encoded by the library that needs no stack for it.
LONG_BLANKS = 200
#: Salts of the first stage of counting.
SALTS = 8
#: A pair with more than a HOT_SHARE-th of all links is sent to every task; by counting there are fewer than HOT_SHARE.
HOT_SHARE = 50_000

Encode = Callable[[list[str]], list[Sequence[int]]]


@dataclass
class Vocabulary:
    """The bytes of each token id, one after another, and where each id's begin."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def vocabulary(bodies: list[bytes]) -> Vocabulary:
    return Vocabulary(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64))


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> tuple[Encode, Vocabulary]:
    """Encoder and vocabulary of a byte-level BPE file; special tokens in a text are plain text.

    Two libraries give the same ids. The quicker one takes ids as merge ranks, so it
    is used where the file's merges are in the order of their ids; it goes down its
    stack over long white space, and such texts go to the other.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, special = byte_letters(), {t["id"] for t in told["added_tokens"] if t["special"]}
    vocab = {t: i for t, i in told["model"]["vocab"].items() if i not in special}
    bodies = [b""] * whole.get_vocab_size()
    for t, i in vocab.items():
        bodies[i] = bytes(letters[c] for c in t)
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    plain = merged == sorted(merged) and told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" and told["pre_tokenizer"]["use_regex"] and not told["pre_tokenizer"]["add_prefix_space"] and not told["model"].get("ignore_merges")
    quick = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={bodies[i]: i for i in vocab.values()}, special_tokens={}) if plain else None

    def encode(texts: list[str]) -> list[Sequence[int]]:
        if quick is None:
            return [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        long = pc.match_substring_regex(pa.array(texts, pa.large_string()), rf"[\s\v\x{{85}}\p{{Z}}]{{{LONG_BLANKS},}}").to_pylist()
        return [whole.encode(t, add_special_tokens=False).ids if slow else quick.encode_ordinary(t) for t, slow in zip(texts, long)]

    return encode, vocabulary(bodies)


def piece_model(path: str) -> tuple[Encode, Vocabulary]:
    """Encoder and vocabulary of a SentencePiece file, U+2581 being a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = [model.id_to_piece(i) for i in range(model.vocab_size())]
    bodies = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
    return lambda texts: model.encode(texts, num_threads=1), vocabulary(bodies)


def _flat(encoded: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the text of each."""
    size = np.array([len(x) for x in encoded], np.int64)
    ids = np.fromiter((i for x in encoded for i in x), np.int64, int(size.sum()))
    return ids, np.repeat(np.arange(len(size)), size)


def _spelt(ids: np.ndarray, rows: np.ndarray, vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts their tokens spell: the joined bytes equal ``data`` from ``offsets`` to the next."""
    n = len(offsets) - 1
    size = np.diff(vocab.offsets)[ids]
    good = np.bincount(rows, size, n).astype(np.int64) == np.diff(offsets)
    on = good[rows]
    ids, rows, size = ids[on], rows[on], size[on]
    total = np.cumsum(size) - size
    joined = vocab.data[np.arange(int(size.sum())) + np.repeat(vocab.offsets[ids] - total, size)]
    kept = data[np.repeat(good, np.diff(offsets))]
    wrong = np.flatnonzero(joined != kept)
    ends = np.cumsum(np.where(good, np.diff(offsets), 0))
    good[np.searchsorted(ends, wrong, "right")] = False
    return good


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``n`` - 1, left-justified with one byte to spare, and how many each has."""
    text = np.char.encode(np.arange(n).astype(str))
    width = text.dtype.itemsize
    out = np.zeros((n, width + 1), np.uint8)
    out[:, :width] = np.frombuffer(text.tobytes(), np.uint8).reshape(n, width)
    return out, np.count_nonzero(out, axis=1)


@dataclass
class Alignment:
    """Groups and links of a run of texts whose tokens spell them.

    ``group_a`` and ``group_b`` are the groups of the tokens, numbered over all texts;
    ``link_a`` and ``link_b`` the tokens of each link, ``link_row`` its text.
    """

    group_a: np.ndarray
    group_b: np.ndarray
    group_row: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_row: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray, row_ends: np.ndarray) -> Alignment:
    """Cut both token sequences where tokens of both end, and link those that end together.

    ``size_a`` and ``size_b`` are the tokens' bytes over all texts, ``row_ends`` where
    each text ends. Every text ends in a cut, so no group runs over two texts.
    """
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    row = np.searchsorted(row_ends, cuts)
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    many_a, many_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    many = many_a * many_b  # one, unless a token has no bytes
    cut = np.repeat(np.arange(len(cuts)), many)
    nth = np.arange(len(cut)) - np.repeat(np.cumsum(many) - many, many)
    return Alignment(group_a, group_b, row, first_a[cut] + nth // many_b[cut], first_b[cut] + nth % many_b[cut], row[cut])


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, digits: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII of ``a1,a2|b1;a3|b2,b3`` of each of ``n`` texts, and its offsets."""
    table, length = digits
    g, groups = len(found.group_row), np.arange(len(found.group_row))
    before_b = np.searchsorted(found.group_b, groups)
    through_a = np.searchsorted(found.group_a, groups, "right")
    place_a = np.arange(len(ids_a)) + before_b[found.group_a]
    place_b = np.arange(len(ids_b)) + through_a[found.group_b]
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    row = np.empty(len(ids), np.int64)
    for place, own, group, last in ((place_a, ids_a, found.group_a, b"|"), (place_b, ids_b, found.group_b, b";")):
        ids[place], row[place] = own, found.group_row[group]
        sign[place] = np.where(np.append(group[1:], g) != group, last[0], b","[0])
    sign[np.flatnonzero(np.append(row[1:] != row[:-1], True))[: len(row)]] = 0  # nothing after a text's last
    out, size = table[ids], length[ids]
    out[np.arange(len(ids)), size] = sign
    flat = out[out > 0]
    return flat, np.concatenate([[0], np.cumsum(np.bincount(row, size + (sign > 0), n).astype(np.int64))])


def aligned(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``.

    A encodes a space and the text, B the text, to which it adds a space. A link is a
    token of A and one of B whose byte ranges end together. ``pairs`` has the distinct
    linked ids of the text, as A's id times B's number of ids plus B's id, and
    ``times`` how many links of the text each has. A text that either side does not
    spell has no tokens.
    """
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, vocab_a), (encode_b, vocab_b) = byte_level(a_path), piece_model(b_path)
        size_a, size_b = np.diff(vocab_a.offsets), np.diff(vocab_b.offsets)
        digits = _decimals(max(len(vocab_a), len(vocab_b)))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                texts = [t or "" for t in part.column("text").to_pylist()]
                raw, at = column_bytes(part.column("text"))
                filled = np.diff(at) > 0
                data = np.insert(raw, at[:-1][filled], 32)
                offsets = at + np.concatenate([[0], np.cumsum(filled)])
                ids_a, row_a = _flat(encode_a([" " + t if t else "" for t in texts]))
                ids_b, row_b = _flat(encode_b(texts))
                good = filled & _spelt(ids_a, row_a, vocab_a, data, offsets) & _spelt(ids_b, row_b, vocab_b, data, offsets)
                ids_a, row_a, ids_b, row_b = ids_a[good[row_a]], row_a[good[row_a]], ids_b[good[row_b]], row_b[good[row_b]]
                found = align(size_a[ids_a], size_b[ids_b], np.cumsum(np.where(good, np.diff(offsets), 0)))
                told, told_at = group_texts(ids_a, ids_b, found, digits, n)
                told = told.tobytes()
                sha = [hashlib.sha256(told[x:y]).hexdigest() if y > x else "" for x, y in zip(told_at[:-1].tolist(), told_at[1:].tolist())]
                code = ids_a[found.link_a] * len(vocab_b) + ids_b[found.link_b]
                every = len(vocab_a) * len(vocab_b)
                key, times = np.unique(found.link_row * every + code, return_counts=True)
                runs = pa.array(row_runs(key // every, n).astype(np.int32))
                count = [pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (row_a, row_b, found.group_row, found.link_row)]
                lists = [pa.ListArray.from_arrays(runs, pa.array(x)) for x in (key % every, times.astype(np.int32))]
                yield pa.record_batch([part.column("id"), *count, pa.array(sha, pa.string()), *lists], names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame, b_ids: int, salts: int = SALTS) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no pair of its B id has more.

    Counting shuffles twice, first by pair and salt; each task sends at most one row a
    pair. The best of each B id is a table no longer than B's vocabulary.
    """
    each = found.select(F.pmod("row", F.lit(salts)).alias("salt"), F.inline(F.arrays_zip("pairs", "times")))
    part = each.groupBy(F.col("pairs").alias("pair"), "salt").agg(F.sum("times").alias("n"))
    counts = stored(part.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % b_ids))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return stored(counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def token_links(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its groups and links, and the counts of all linked id pairs.

    The first frame has id, n_a, n_b, n_groups, n_links, n_best (links whose count is the
    highest of their B id, ties included), count_sum (of the counts of all links) and
    groups_sha256 (of the groups' ids, '' without tokens); the second a_id, b_id, n, best.

    Counts go back to the texts by two ways: those of the most frequent pairs, whose
    number is bounded by counting, are sent to all tasks; the rest are joined, where no
    pair has more than a ``hot_share``-th of all links.

    Defined cases: a null or empty text, and one that a tokenizer does not spell (as
    where it has a literal U+2581), has no tokens and zeros; tokens' names in a text are
    plain text; very long texts are encoded whole; repeated rows each give a row and
    count each; a null id stays null; an empty table gives none; other columns are not
    looked at.
    """
    b_ids = len(piece_model(b_path)[1])
    found = stored(aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(found, b_ids)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total // hot_share).toArrow().combine_chunks().sort_by("pair")  # fewer than hot_share rows
    sent = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    told = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        pair = sent.value[0]
        pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        slot = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
        hit = pair[slot] == pairs if len(pair) else np.zeros(len(pairs), bool)
        size = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64)
        return pairs, times, slot, hit, size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for batch in batches:
            _, times, slot, hit, size = looked_up(batch)
            ends = np.cumsum(size)
            per = []
            for value in (best, n):
                gained = np.zeros(len(times) + 1, np.int64)
                gained[1:][hit] = times[hit] * value[slot[hit]]
                run = np.cumsum(gained)
                per.append(pa.array(run[ends] - run[ends - size]))
            yield pa.record_batch([*(batch.column(c) for c in told), *per], [*told, "best_hot", "sum_hot"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, _, hit, size = looked_up(batch)
            row = np.repeat(batch.column("row").to_numpy(), size)
            yield pa.record_batch([pa.array(x[~hit]) for x in (row, pairs, times)], ["row", "pair", "times"])

    id_kind = found.schema["id"].dataType.simpleString()
    near = found.select(*told, "pairs", "times").mapInArrow(sums, f"row long, id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best_hot long, sum_hot long")
    cold = found.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long")
    rest = cold.join(counts.where(F.col("n") <= total // hot_share), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_cold"), F.sum(F.col("times") * F.col("n")).alias("sum_cold"))
    out = near.join(rest, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    links = out.select("id", "n_a", "n_b", "n_groups", "n_links", add("best_hot", "best_cold").alias("n_best"), add("sum_hot", "sum_cold").alias("count_sum"), "groups_sha256")
    return links, counts.select(F.floor(F.col("pair") / b_ids).alias("a_id"), (F.col("pair") % b_ids).alias("b_id"), "n", "best")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the groups and links of their tokens in both vocabularies."""
    links, _ = token_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return links.withColumnRenamed("id", "doc_id")
