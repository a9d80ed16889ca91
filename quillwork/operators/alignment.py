"""Comparison of document pairs: sequence alignment, moves, format changes, revisions, round trips."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from math import isqrt
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.formatting import changed_properties, property_diff
from ..lineage import settled

# Least similarities of paragraphs, of blocks and of moves, and the fewest words of a move.
PARAGRAPH_SIMILARITY = 0.25
BLOCK_SIMILARITY = 0.5
MOVE_SIMILARITY = 0.8
MOVE_WORDS = 5
SAME = 0.9999
#: Cells of one alignment table, a bit each; of a larger one only every so many rows are kept, and those between are made again.
TABLE_CELLS = 64_000_000


def _rows(a: Sequence, where: dict, width: int, first: int, every: int = 1) -> list[int]:
    """Every so many rows of the table of lengths of common subsequences, from the row ``first`` that stands before ``a``.

    A row is one whole number: bit j is 0 where the length grows from column j to the
    next. ``where`` has the places of each item in the other sequence, as bits.
    """
    full, row, kept = (1 << width) - 1, first, [first]
    for i, x in enumerate(a, 1):
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
        if i % every == 0:
            kept.append(row)
    return kept


def lcs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    What both end with is matched first; so is what both start with as long as it
    stands once on either side, where no other match can be. Only the middle needs a
    table. Its rows are bits of whole numbers. Walking back, a tie goes to the shorter ``b``.
    Of a table over TABLE_CELLS, one row of a block is kept and the walk makes its block
    again, so the pairs are the same at any size and the memory is that of 2 sqrt(n) rows.
    """
    n, m, tail, head = len(a), len(b), 0, 0
    while tail < min(n, m) and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    if tail < min(n, m) and a[0] == b[0]:
        often = Counter(a[: n - tail]), Counter(b[: m - tail])
        while head < min(n, m) - tail and a[head] == b[head] and often[0][a[head]] == often[1][a[head]] == 1:
            head += 1
    middle = [(i + head, j + head) for i, j in _lcs(a[head : n - tail], b[head : m - tail])]
    return [(i, i) for i in range(head)] + middle + [(n - k, m - k) for k in range(tail, 0, -1)]


def _lcs(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    n, m = len(x), len(y)
    if not n or not m:
        return []
    where: dict = {}
    for j, t in enumerate(y):
        where[t] = where.get(t, 0) | 1 << j
    every = n if (n + 1) * (m + 1) <= TABLE_CELLS else isqrt(n)
    start = (1 << m) - 1
    kept = _rows(x, where, m, start, every) if every < n else [start]
    out, i, j = [], n, m
    while i and j:
        base = (i - 1) // every * every
        table = _rows(x[base:i], where, m, kept[base // every])
        while i > base and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif table[i - base] >> (j - 1) & 1:  # no longer than without the last of y
                j -= 1
            else:
                i -= 1
    return out[::-1]


def similarity(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return float(x == y)
    return len(x & y) / len(x | y)


def greedy_pairs(left: Sequence[str], right: Sequence[str], least: float, reuse: bool = False) -> list[tuple[int, int, float]]:
    """For each left text in order the most similar free right one, the first of equals, from ``least`` (over 0) on.

    Two sets of words that agree so far share one of the rarest (1 - least) * n + 1 words
    of each, so right texts are looked up by these.
    """
    if not left or not right or least > 1:
        return []
    mine, theirs = [frozenset(t.split()) for t in left], [frozenset(t.split()) for t in right]
    often = Counter(w for ws in (*mine, *theirs) for w in ws)
    rare = lambda ws: [w for _, w in sorted((often[w], w) for w in ws)[: int(len(ws) * (1 - least) + 1e-9) + 1]] if ws else [None]
    index: dict[str | None, list[int]] = {}
    for j, ws in enumerate(theirs):
        for w in rare(ws):
            index.setdefault(w, []).append(j)
    free, out = set(range(len(right))), []
    for i, ws in enumerate(mine):
        best, at, size = 0.0, -1, len(ws)
        for j in sorted({j for w in rare(ws) for j in index.get(w, ())} & free):
            other = len(theirs[j])
            if min(size, other) + 1e-9 < max(size, other) * least:
                continue
            shared = len(ws & theirs[j])
            score = shared / (size + other - shared) if ws else 1.0
            if score > best:
                best, at = score, j
        if at >= 0 and best >= least:
            out.append((i, at, best))
            if not reuse:
                free.discard(at)
    return out


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


_TOKEN = re.compile(r"\s+|\S+")


def tokenise(text: str) -> list[str]:
    """Words and white space, both kept."""
    return _TOKEN.findall(text)


def compare_texts(original: Sequence[str], revised: Sequence[str], least: float = PARAGRAPH_SIMILARITY) -> list[tuple[str, int, int, str]]:
    """Atoms (status, original paragraph, revised paragraph, text) of a comparison; -1 for none: those of ``_compared``, one by one."""
    return [(status, i, j, t) for status, i, j, tokens, _ in _compared(original, revised, least) for t in tokens]


def _compared(original: Sequence[str], revised: Sequence[str], least: float = PARAGRAPH_SIMILARITY) -> list[tuple[str, int, int, list[str], str | None]]:
    """Atoms (status, original paragraph, revised paragraph, tokens, text) of a comparison, a paragraph of one status being one, with its text.

    Paragraphs are aligned by their normalised text, those left over by similarity,
    and the tokens inside matched pairs by their own alignment. Atoms stand in the
    order of the result: what was deleted comes before what follows it in the revision.
    """
    a, b = [normalise(t) for t in original], [normalise(t) for t in revised]
    pairs = dict(lcs(a, b))
    left = [i for i in range(len(a)) if i not in pairs]
    used = set(pairs.values())
    right = [j for j in range(len(b)) if j not in used]
    pairs |= {left[i]: right[j] for i, j, _ in greedy_pairs([a[i] for i in left], [b[j] for j in right], least)}
    back = {j: i for i, j in pairs.items()}
    out: list[tuple[str, int, int, list[str], str | None]] = []
    told = 0

    def deleted(stop: int) -> None:
        nonlocal told
        for i in range(told, stop):
            if i not in pairs:
                out.append(("Deleted", i, -1, tokenise(original[i]) or [""], original[i]))
        told = max(told, stop)

    for j, text in enumerate(revised):
        if j not in back:
            out.append(("Inserted", -1, j, tokenise(text) or [""], text))
            continue
        i = back[j]
        deleted(i)
        x = tokenise(original[i])
        if original[i] == text:
            out.append(("Equal", i, j, x or [""], text))
            continue
        y = tokenise(text)
        p = q = 0
        for s, t in [*lcs(x, y), (len(x), len(y))]:
            out += [(status, i, j, tokens, None) for status, tokens in (("Deleted", x[p:s]), ("Inserted", y[q:t]), ("Equal", x[s : s + 1])) if tokens]
            p, q = s + 1, t + 1
    deleted(len(original))
    return out


ATOMS = "pair_id long, atom_idx long, status string, orig_para int, rev_para int, text string"
#: All statuses of a comparison, for ``joined``.
STATUSES = ("Equal", "Deleted", "Inserted")
#: Rows of one batch that goes back from a kernel, and the types of its columns.
BATCH_ROWS = 50_000
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<struct<status:string,text:string>>": pa.list_(pa.struct([("status", pa.string()), ("text", pa.string())]))}


def _stretches(compared: list[tuple[str, int, int, list[str], str | None]], joined: Sequence[str] = STATUSES) -> list[tuple[int, str, int, int, str, int]]:
    """(atom_idx, status, original paragraph, revised paragraph, text, tokens): neighbours of one of these statuses and of one pair of paragraphs as one."""
    out, n = [], 0
    for (status, i, j), same in groupby(compared, itemgetter(0, 1, 2)):
        first, *others = same
        texts = [t for c in (first, *others) for t in c[3]] if others else first[3]
        if status in joined:
            # a whole paragraph is not put together again
            out.append((n, status, i, j, "".join(texts) if others or first[4] is None else first[4], len(texts)))
        else:
            out.extend((n + k, status, i, j, t, 1) for k, t in enumerate(texts))
        n += len(texts)
    return out


def _each_pair(pairs: DataFrame, rows_of: Callable[[list[str], list[str]], list[tuple]], schema: str) -> DataFrame:
    """What a function of both sides tells of each pair, one after another; ``schema`` begins with the pair's id.

    Few bytes can be much work, so pairs are spread over all cores by number, not by size.
    A null side is a document without paragraphs, a null paragraph an empty one. Rows go
    back in batches over pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])
        rows: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)
        for batch in batches:
            for pair, *sides in zip(*batch.columns):
                pair = pair.as_py()
                rows += [(pair, *r) for r in rows_of(*([t or "" for t in side.as_py() or ()] for side in sides))]
                if len(rows) >= BATCH_ROWS:
                    yield made()
                    rows = []
        if rows:
            yield made()

    spark = pairs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "original", "revised").repartition(tasks, "pair_id").mapInArrow(run, schema)


def compare_pairs(pairs: DataFrame, least: float = PARAGRAPH_SIMILARITY, joined: Sequence[str] = ()) -> DataFrame:
    """Atoms of each pair (pair_id, original array<string>, revised array<string>); pairs run apart.

    The alignment of a pair is dynamic programming, so a pair is one row of a Python
    kernel; its memory is bounded by the kernel's table. Neighbours of the statuses in
    ``joined`` that are of one pair of paragraphs are one row, with the number of the
    first and how many they are as ``tokens``: what reads texts and not words needs no more.
    """
    if joined:
        return _each_pair(pairs, lambda a, b: _stretches(_compared(a, b, least), joined), f"{ATOMS}, tokens int")
    return _each_pair(pairs, lambda a, b: [(n, *r) for n, r in enumerate(compare_texts(a, b, least))], ATOMS)


#: Words as ``X.word_count`` counts them.
_WORD = re.compile("[^ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def _moved(rows: list[tuple], least: float, least_words: int) -> tuple[list[int | None], list[tuple[int, int, int, float]]]:
    """The moves of one pair's stretches, as ``moves`` has them, and for each stretch the number of its block (None: equal)."""
    blocks: list[tuple[int, str, list[str]]] = []
    own: list[int | None] = [None] * len(rows)
    n, last = 0, None
    for other in ("Inserted", "Deleted"):
        for k, (_, status, _, _, text, _) in enumerate(rows):
            if status == other:
                continue
            if status != last:
                n, last = n + 1, status
                if status != "Equal":
                    blocks.append((n, status, []))
            if status != "Equal":
                blocks[-1][2].append(text)
                own[k] = n
    texts = [(n, status, "".join(t)) for n, status, t in blocks]
    big = [b for b in texts if len(_WORD.findall(b[2])) >= least_words]
    gone, new = ([(n, t) for n, s, t in big if s == status] for status in ("Deleted", "Inserted"))
    found = greedy_pairs([t.lower() for _, t in gone], [t.lower() for _, t in new], least)
    return own, [(k, gone[i][0], new[j][0], s) for k, (i, j, s) in enumerate(found, 1)]


def pair_moves(pairs: DataFrame, least: float = MOVE_SIMILARITY, least_words: int = MOVE_WORDS) -> DataFrame:
    """``moves`` of the comparison of each pair (pair_id, original, revised), told where it is compared: no atom leaves its task."""

    def rows_of(a: list[str], b: list[str]) -> list[tuple]:
        found = _moved(_stretches(_compared(a, b)), least, least_words)[1]
        return [(k, f"move{k}", i, j, s) for k, i, j, s in found]

    return _each_pair(pairs, rows_of, MOVES)


def compare_with_moves(pairs: DataFrame, least: float = MOVE_SIMILARITY, least_words: int = MOVE_WORDS) -> DataFrame:
    """``with_moves`` of the comparison of each pair (pair_id, original, revised), neighbours joined as by ``compare_pairs``."""

    def rows_of(a: list[str], b: list[str]) -> list[tuple]:
        rows = _stretches(_compared(a, b))
        own, found = _moved(rows, least, least_words)
        to = {i: ("MovedSource", k) for k, i, _, _ in found} | {j: ("MovedDestination", k) for k, _, j, _ in found}
        out = []
        for (n, status, i, j, text, tokens), block in zip(rows, own):
            status, group = to.get(block, (status, None))
            out.append((n, status, i, j, text, tokens, group))
        return out

    return _each_pair(pairs, rows_of, f"{ATOMS}, tokens int, move_group int")


def unified_index(atoms: DataFrame) -> DataFrame:
    """Adds para_idx: the paragraphs of the merged output in its order, from 0, those of both sides zipped together."""
    first = atoms.withColumn("__first", F.min("atom_idx").over(Window.partitionBy("pair_id", "orig_para", "rev_para")))
    return first.withColumn("para_idx", F.dense_rank().over(Window.partitionBy("pair_id").orderBy("__first")) - 1).drop("__first")


#: Least similarities of paragraphs that are tried in turn.
PASSES = (0.25, 0.35, 0.5, 0.75)


def compare_documents(pairs: DataFrame, passes: Sequence[float] = PASSES, joined: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(atoms, report) of pairs (pair_id, original, revised): each pair by the first pass that survives the round trip.

    A pass is safe for a pair if accepting all its changes gives the revision and
    rejecting all gives the original. Pairs that no pass is safe for are rebuilt: all
    their old paragraphs are deleted and the new ones inserted. The report has pair_id,
    mode (aligned or rebuilt) and the number of the pass, from 1. ``joined`` is that of ``compare_pairs``.
    """
    todo, kept, told = pairs.select("pair_id", "original", "revised"), [], []
    for n, least in enumerate((*passes, 2.0), 1):
        rebuilt = n > len(passes)
        atoms = settled(compare_pairs(todo, least, joined))
        ok = round_trip(atoms, todo).where(F.lit(rebuilt) | (F.col("accepts") & F.col("rejects"))).select("pair_id")
        ok = settled(ok)
        kept.append(atoms.join(ok, "pair_id", "left_semi"))
        told.append(ok.withColumn("mode", F.lit("rebuilt" if rebuilt else "aligned")).withColumn("pass", F.lit(n)))
        todo = todo.join(ok, "pair_id", "left_anti")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, told)


def _blocked(atoms: DataFrame) -> DataFrame:
    """Atoms with the number of their block, over the original's atoms and then the revision's; equal ones stand in both."""
    from .ordered import islands

    side = F.explode(F.when(F.col("status") == "Equal", F.array(F.lit(0), F.lit(1))).when(F.col("status") == "Deleted", F.array(F.lit(0))).otherwise(F.array(F.lit(1))))
    rows = atoms.withColumn("__side", side).withColumn("__at", F.struct("__side", "atom_idx"))
    return islands(rows, ["pair_id"], "__at", ["status"], "block")


def blocks(atoms: DataFrame) -> DataFrame:
    """Deleted and inserted blocks of each pair, over the original's atoms and then the revision's."""
    rows = _blocked(atoms)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "text"))), lambda x: x["text"]), "")
    out = rows.where("status <> 'Equal'").groupBy("pair_id", "block", "status").agg(text.alias("text"), F.min("atom_idx").alias("first_atom"), F.max("atom_idx").alias("last_atom"))
    return out.withColumn("words", X.word_count(F.col("text")))


MOVES = "pair_id long, move_group int, move_name string, source_block long, target_block long, similarity double"


def moves(atoms: DataFrame, least: float = MOVE_SIMILARITY, least_words: int = MOVE_WORDS) -> DataFrame:
    """(pair_id, move_group, move_name, source_block, target_block, similarity): deleted blocks found again.

    Deleted blocks in order take the most similar inserted block that is free.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                gone = [(x["block"], x["text"]) for x in r.blocks if x["status"] == "Deleted"]
                new = [(x["block"], x["text"]) for x in r.blocks if x["status"] == "Inserted"]
                found = greedy_pairs([t.lower() for _, t in gone], [t.lower() for _, t in new], least)
                out += [(r.pair_id, k, f"move{k}", gone[i][0], new[j][0], s) for k, (i, j, s) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["pair_id", "move_group", "move_name", "source_block", "target_block", "similarity"])

    rows = blocks(atoms).where(F.col("words") >= least_words)
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("block", "status", "text"))).alias("blocks")).mapInPandas(run, MOVES)


def with_moves(atoms: DataFrame, found: DataFrame) -> DataFrame:
    """Atoms with MovedSource and MovedDestination for those in moved blocks, and their move group.

    Atoms are numbered by block as the moves' blocks are, so the two meet by number.
    """
    places = found.select("pair_id", F.explode(F.array(F.struct(F.col("source_block").alias("block"), F.lit("MovedSource").alias("to")), F.struct(F.col("target_block").alias("block"), F.lit("MovedDestination").alias("to")))).alias("x"), "move_group")
    spans = places.select("pair_id", "x.block", F.col("x.to").alias("__to"), "move_group")
    joined = _blocked(atoms).where("status <> 'Equal' or __side = 0").join(spans, ["pair_id", "block"], "left")
    return joined.select("pair_id", "atom_idx", F.coalesce("__to", "status").alias("status"), "orig_para", "rev_para", "text", "move_group")


def move_ids(found: DataFrame, first: int = 1) -> DataFrame:
    """Four revision ids for each move of a pair, in order."""
    base = (F.dense_rank().over(Window.partitionBy("pair_id").orderBy("move_group")) - 1) * 4 + first
    return found.withColumn("ids", F.sequence(base, base + 3))


def format_changes(atoms: DataFrame) -> DataFrame:
    """Equal atoms (old_props, new_props maps) whose formatting differs: added, removed, changed and plain names."""
    diff = property_diff(F.col("old_props"), F.col("new_props"))
    rows = atoms.where("status = 'Equal'").withColumn("names", changed_properties(F.col("old_props"), F.col("new_props")))
    return rows.where(F.size("names") > 0).withColumns({k: diff[k] for k in ("added", "removed", "changed")}).withColumn("status", F.lit("FormatChanged"))


_SIDES = {True: (("Equal", "Inserted", "MovedDestination"), "rev_para"), False: (("Equal", "Deleted", "MovedSource"), "orig_para")}


def side_text(atoms: DataFrame, accept: bool) -> DataFrame:
    """The revised (accept) or original text of each pair; paragraphs are joined by line ends."""
    status, para = _SIDES[accept]
    return _joined(atoms.where(F.col("status").isin(*status)), F.lit(accept), para).select("pair_id", "text")


def _joined(atoms: DataFrame, accept: Column, para: str) -> DataFrame:
    """(pair_id, accept, text): the texts of atoms in order, paragraph by paragraph."""
    parts = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), "text"))), lambda x: x["text"]), "" if at == "atom_idx" else "\n")
    rows = atoms.groupBy("pair_id", accept.alias("accept"), F.col(para).alias("p")).agg(parts("atom_idx").alias("text"))
    return rows.groupBy("pair_id", "accept").agg(parts("p").alias("text"))


def round_trip(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether accepting all gives the revision and rejecting all the original, for each pair.

    Each atom is dealt to the sides that hold it, so the comparison runs once.
    """
    sides = F.array_compact(F.array(*[F.when(F.col("status").isin(*status), F.struct(F.lit(accept).alias("accept"), F.col(para).alias("para"))) for accept, (status, para) in _SIDES.items()]))
    dealt = atoms.select("pair_id", "atom_idx", "text", F.explode(sides).alias("s")).select("pair_id", "atom_idx", "text", "s.*")
    texts = _joined(dealt, F.col("accept"), "para").groupBy("pair_id").agg(F.max(F.when(F.col("accept"), F.col("text"))).alias("accepted"), F.max(F.when(~F.col("accept"), F.col("text"))).alias("rejected"))
    same = lambda a, b: F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.array_join(F.transform(b, lambda t: F.coalesce(t, F.lit(""))), "\n"), F.lit(""))
    return pairs.join(texts, "pair_id", "left").select("pair_id", same("accepted", "revised").alias("accepts"), same("rejected", "original").alias("rejects"))


def revisions(atoms: DataFrame) -> DataFrame:
    """Changed paragraphs with text before and after, their kind, and their entries by kind and then place."""
    key = F.coalesce(F.nullif("rev_para", F.lit(-1)), F.col("orig_para") + F.lit(0.5))
    rows = atoms.withColumn("para_key", key)
    text = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("atom_idx", "status", "text"))), lambda x: x["status"].isin(*keep)), lambda x: x["text"]), "")
    gone, new = ("Deleted", "MovedSource"), ("Inserted", "MovedDestination")
    kinds = F.create_map(*[F.lit(x) for pair in zip(("Inserted", "Deleted", "MovedSource", "MovedDestination"), range(4)) for x in pair])
    entries = F.array_sort(F.collect_list(F.when(F.col("status") != "Equal", F.struct(F.element_at(kinds, F.col("status")).alias("rank"), "atom_idx", "status", "text"))))
    out = rows.groupBy("pair_id", "para_key").agg(text(("Equal", *gone)).alias("before"), text(("Equal", *new)).alias("after"), F.bool_or(F.col("status").isin(*gone)).alias("has_gone"), F.bool_or(F.col("status").isin(*new)).alias("has_new"), F.bool_or(F.col("status") == "Equal").alias("has_equal"), entries.alias("entries"))
    kind = F.when(~F.col("has_gone") & ~F.col("has_equal"), "inserted").when(~F.col("has_new") & ~F.col("has_equal"), "deleted").otherwise("modified")
    return out.where("has_gone OR has_new").select("pair_id", "para_key", "before", "after", kind.alias("kind"), F.transform("entries", lambda e: F.struct(e["status"].alias("status"), e["text"].alias("text"))).alias("entries"))


REVISIONS = "pair_id long, para_key double, before string, after string, kind string, entries array<struct<status:string,text:string>>"


def _revised(compared: list[tuple[str, int, int, list[str], str | None]], offset: int, limit: int) -> list[tuple[float, str, str, str, list[dict]]]:
    """``revisions`` of one pair from a 0-based offset on, so many at most."""
    paras: dict[float, list[tuple[str, list[str], str | None]]] = {}
    for status, i, j, tokens, text in compared:
        if tokens:
            paras.setdefault(float(j) if j != -1 else i + 0.5, []).append((status, tokens, text))
    changed = [k for k in sorted(paras) if any(s != "Equal" for s, _, _ in paras[k])]
    out = []
    for key in changed[offset : offset + limit]:
        own = paras[key]
        without = lambda other: "".join(t if t is not None else "".join(ts) for s, ts, t in own if s != other)  # noqa: B023, E731
        has = {s for s, _, _ in own}
        kind = "inserted" if has == {"Inserted"} else "deleted" if has == {"Deleted"} else "modified"
        out.append((key, without("Inserted"), without("Deleted"), kind, [{"status": s, "text": t} for status in ("Inserted", "Deleted") for s, ts, _ in own if s == status for t in ts]))
    return out


def pair_revisions(pairs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of ``revisions`` of the comparison of each pair (pair_id, original, revised), by ``revision_page``'s rule: told where it is compared, so no atom leaves its task."""
    limit = min(max(limit, 1), 500)
    return _each_pair(pairs, lambda a, b: _revised(_compared(a, b), offset, limit), REVISIONS)


def paragraph_operations(original: Sequence[str], revised: Sequence[str], least: float = BLOCK_SIMILARITY) -> list[tuple[str, int, int]]:
    """unchanged, modified, inserted and deleted paragraphs in the order of the revision; what is left comes last."""
    a, b = [normalise(t) for t in original], [normalise(t) for t in revised]
    pairs = dict(lcs(a, b))
    used = set(pairs.values())
    left, right = [i for i in range(len(a)) if i not in pairs], [j for j in range(len(b)) if j not in used]
    pairs |= {left[i]: right[j] for i, j, _ in greedy_pairs([a[i] for i in left], [b[j] for j in right], least)}
    back, out, told = {j: i for i, j in pairs.items()}, [], 0
    for j in range(len(b)):
        if j in back:
            i = back[j]
            out += [("deleted", k, -1) for k in range(told, i) if k not in pairs]
            told = max(told, i + 1)
            out.append(("unchanged" if similarity(a[i], b[j]) >= SAME and a[i] == b[j] else "modified", i, j))
        else:
            out.append(("inserted", -1, j))
    return out + [("deleted", k, -1) for k in range(told, len(a)) if k not in pairs]


def compare_paragraphs(pairs: DataFrame, least: float = BLOCK_SIMILARITY) -> DataFrame:
    """(pair_id, place, op, orig_para, rev_para) of each pair (pair_id, original, revised): what was done to each paragraph, in order."""
    schema = "pair_id long, place int, op string, orig_para int, rev_para int"
    return _each_pair(pairs, lambda a, b: [(n, *r) for n, r in enumerate(paragraph_operations(a, b, least))], schema)


def paragraph_changes(pairs: DataFrame, least: float = BLOCK_SIMILARITY) -> DataFrame:
    """``compare_paragraphs`` with the text before and after, and for modified paragraphs the operations between them by character."""
    from .chars import diff_ops

    at = lambda c, i: F.when(F.col(i) >= 0, F.coalesce(F.get(c, F.col(i)), F.lit("")))
    rows = compare_paragraphs(pairs, least).join(pairs.select("pair_id", "original", "revised"), "pair_id")
    rows = rows.select("pair_id", "place", "op", "orig_para", "rev_para", at("original", "orig_para").alias("before"), at("revised", "rev_para").alias("after"))
    changed = F.col("op") == "modified"
    return rows.withColumn("ops", diff_ops(F.when(changed, F.col("before")), F.when(changed, F.col("after"))))


def candidate_pairs(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (a, b, shared, total) of texts (id, text) whose word sets agree to ``least``.

    A prefix filter: words are ranked by how rare they are, and two sets that agree
    that much share one of the first (1 - least) * n + 1 words of each. Texts whose
    sets are equal count once, by the smallest id, so that copies give no pairs; sizes
    must fit too. Returns pairs between such representatives.
    """
    sets = texts.select("id", F.array_sort(F.array_distinct(X.words(F.lower("text")))).alias("ws")).where(F.size("ws") > 0)
    reps = sets.groupBy("ws").agg(F.min("id").alias("id"))
    said = reps.select("id", F.explode("ws").alias("w"))
    often = said.groupBy("w").agg(F.count("*").alias("n"))
    ranked = said.join(often, "w").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ws"))
    ranked = ranked.withColumn("size", F.size("ws"))
    first = F.slice("ws", F.lit(1), (F.floor(F.col("size") * (1 - least) + 1e-9) + 1).cast("int"))
    keys = ranked.select("id", "size", F.explode(first).alias("w"))
    left, right = keys.toDF("a", "na", "w"), keys.toDF("b", "nb", "w")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)
    pairs = left.join(right, "w").where(fits).select("a", "b").distinct()
    a, b = ranked.select(F.col("id").alias("a"), F.col("ws").alias("wa")), ranked.select(F.col("id").alias("b"), F.col("ws").alias("wb"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"), F.size(F.array_union("wa", "wb")).alias("total"))
    return rows.where(F.col("shared") >= F.col("total") * least)


def word_set_classes(texts: DataFrame) -> DataFrame:
    """(id, representative) of every text (id, text) with words: the smallest id whose word set is the same."""
    sets = texts.select("id", F.array_sort(F.array_distinct(X.words(F.lower("text")))).alias("ws")).where(F.size("ws") > 0)
    reps = sets.groupBy("ws").agg(F.min("id").alias("representative"))
    return sets.join(reps, "ws").select("id", "representative")


def class_links(texts: DataFrame) -> DataFrame:
    """(a, b) of every text b and the representative a of its class, where the two are different texts."""
    rows = word_set_classes(texts).where("id <> representative")
    own, first = texts.toDF("b", "tb"), texts.toDF("a", "ta")
    return rows.toDF("b", "a").join(own, "b").join(first, "a").where("ta <> tb").select("a", "b")


def best_partners(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, partner, score) of every text (id, text) with a partner: the most similar other one, the smallest id of a tie.

    Texts whose word sets are equal, copies too, have each other; the others look at both sides of ``candidate_pairs``.
    """
    classes = word_set_classes(texts)
    second = classes.where("id <> representative").groupBy("representative").agg(F.min("id").alias("second"))
    members = classes.join(second, "representative").select("id", F.when(F.col("id") == F.col("representative"), F.col("second")).otherwise(F.col("representative")).alias("partner"), F.lit(1.0).alias("score"))
    pairs = candidate_pairs(texts, least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("partner")), F.struct(F.col("b").alias("id"), F.col("a").alias("partner")))).alias("x"), "shared", "total").select("x.*", "shared", "total")
    alone = both.join(members.select("id"), "id", "left_anti")
    return members.unionByName(best_match(alone, "id", "partner", F.col("shared") / F.col("total")))


def similar_across(items: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (item, id, shared, total) of ``items`` and ``texts`` (both id, text) whose word sets agree to ``least``.

    Each word of an item meets the texts that have it, and the meetings of an item and a
    text of fitting sizes are what they share: texts are cut into words once and never
    sorted, grouped or compared as sets. Copies and rows of one id stay rows of their own.
    """

    def said(rows: DataFrame, name: str) -> DataFrame:
        sets = rows.select(F.monotonically_increasing_id().alias(f"{name}_row"), F.col("id").alias(name), F.array_distinct(X.words(F.lower("text"))).alias("ws"))
        return sets.select(f"{name}_row", name, F.size("ws").alias(f"{name}_size"), F.explode("ws").alias("w"))

    sizes = F.col("item_size"), F.col("id_size")
    met = said(texts, "id").join(said(items, "item"), "w").where(F.least(*sizes) >= F.greatest(*sizes) * least)
    rows = met.groupBy("item_row", "id_row", "item", "id", *sizes).agg(F.count("*").cast("int").alias("shared")).withColumn("total", sizes[0] + sizes[1] - F.col("shared"))
    return rows.where(F.col("shared") >= F.col("total") * least).select("item", "id", "shared", "total")


def best_match(pairs: DataFrame, left: str, right: str, score: Column) -> DataFrame:
    """The best right side of each left one; the first wins a tie."""
    return pairs.groupBy(left).agg(F.max_by(right, F.struct(score.alias("s"), (-F.col(right)).alias("o"))).alias(right), F.max(score).alias("score"))
