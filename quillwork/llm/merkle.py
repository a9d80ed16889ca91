"""A Merkle manifest of a dataset: Pregel-style supersteps up a tree of digests and back down to its leaves.

Going up, every node sends its digest to its parent; a parent that has heard from all
its children hashes them and is a node of the next superstep. Going down, every parent
sends each child the digests beside it and all that it was sent itself, so that a leaf
ends up with its whole path. A node of many leaves is read once: paths are shared by a
run of leaves and only expanded where the leaves are told.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import stored

#: Children of a node.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where this divides the checksum of a leaf's id, the leaf is tampered with.
TAMPER = 5

#: (place among the run, digests of the whole run) of each level, from the leaf up.
Path = tuple[tuple[int, tuple[bytes, ...]], ...]

NODE = "grp string, idx long, n long, digest binary, id {kind}, other binary, children array<struct<digest:binary,id:{kind},other:binary>>"


def hashed(digests: Iterable[bytes]) -> bytes:
    """The digest of digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def fold(digest: bytes, path: Path) -> bytes:
    """The root that follows from a digest and its path."""
    for at, run in path:
        digest = hashed([*run[:at], digest, *run[at + 1 :]])
    return digest


def proof(path: Path) -> bytes:
    """The digest of all digests beside the path, level by level, left to right."""
    return hashed(d for at, run in path for i, d in enumerate(run) if i != at)


def told(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[told(v) for v in values]), 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: Sequence[str], group: str | None = None) -> DataFrame:
    """``rows`` with idx (from 0 in its group, in this order, nulls first) and n (rows of the group).

    Rows are range partitioned by ``order``, which starts with the group, so a large
    group lies in many partitions; only how many rows of each group a partition has is
    counted and added up. Rows equal in ``order`` may stand either way.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    keyed = placed.withColumns({"part": part, "key": F.col(group) if group else F.lit(None).cast("string")})
    counts = keyed.groupBy("part", "key").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "key", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    c = counts.toDF("c_part", "c_key", "first", "before", "n")
    out = keyed.join(c, (F.col("part") == F.col("c_part")) & F.col("key").eqNullSafe(F.col("c_key")))
    return out.select(*rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("idx"), "n")


def _shared(parts: int) -> dict:
    """Partitioner of (group, index) keys, alike on every machine."""
    return {"numPartitions": max(1, parts), "partitionFunc": lambda key: zlib.crc32(repr(key).encode())}


def _met(nodes: RDD, sent: RDD, parts: int) -> RDD:
    """(key, (node, message)) of the nodes that were sent one; keys are unique on both sides."""
    both = nodes.mapValues(lambda v: (0, v)).union(sent.mapValues(lambda v: (1, v)))
    pairs = both.groupByKey(**_shared(parts)).mapValues(lambda v: sorted(v, key=lambda x: x[0]))
    return pairs.filter(lambda x: len(x[1]) == 2).mapValues(lambda v: (v[0][1], v[1][1]))


@dataclass
class Tree:
    """Tables of the nodes of each level, leaves first; ``kind`` is the type of the leaves' ids."""

    levels: list[DataFrame]
    kind: str

    def roots(self) -> DataFrame:
        """(grp, digest): the node that remains of each group."""
        out = [t.where("n = 1").select("grp", "digest") for t in self.levels]
        return out[0] if len(out) == 1 else out[0].unionByName(Tree(self.levels[1:], self.kind).roots())


def climb(leaves: DataFrame, fan: int = FAN) -> Tree:
    """Supersteps up: (grp, idx, n, digest, id, other) leaves to the one node that remains of each group.

    ``id`` and ``other`` are the leaf's own name and another digest of it, which its
    parent keeps beside its digest for the way down.
    """
    spark, kind = leaves.sparkSession, leaves.schema["id"].dataType.simpleString()
    schema = NODE.format(kind=kind)
    leaves = stored(leaves)
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def send(r) -> tuple:
        return (r.grp, r.idx // fan), (r.idx % fan, bytes(r.digest), r.id, None if r.other is None else bytes(r.other), r.n)

    def complete(item: tuple) -> tuple:
        (grp, idx), heard = item
        heard = sorted(heard, key=lambda m: m[0])
        n = heard[0][4]
        if [m[0] for m in heard] != list(range(min(fan, n - idx * fan))):
            raise ValueError(f"node {idx} of {grp!r} did not hear from all its children")
        return grp, idx, -(-n // fan), hashed(m[1] for m in heard), None, None, [(m[1], m[2], m[3]) for m in heard]

    while most > 1:
        parts //= 1 if len(levels) == 1 else fan
        sent = levels[-1].where("n > 1").select("grp", "idx", "n", "digest", "id", "other").rdd.map(send)
        done = sent.groupByKey(**_shared(parts)).map(complete)  # at most ``fan`` messages a key
        levels.append(stored(spark.createDataFrame(done, schema)))
        most = -(-most // fan)
    return Tree(levels, kind)


def descend(tree: Tree, starts: RDD, told: Callable[[object, object, Path], Iterator[tuple]], fan: int = FAN) -> RDD:
    """Supersteps down: what ``told`` gives of (group's start, leaf, path) for every leaf.

    ``starts`` has (group, (start, path)) for each group: what its root is sent. A leaf
    is (digest, id, other).
    """
    parts = int(tree.levels[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    above: RDD | None = None  # messages to the nodes of the level
    out = None
    for level in range(len(tree.levels) - 1, -1, -1):
        wide = parts // fan ** max(level - 1, 0)
        nodes = tree.levels[level]
        roots = starts.map(lambda s: ((s[0], 0), s[1]))
        if level == 0:  # only groups of one leaf are reached here
            alone = nodes.where("n = 1").select("grp", "digest", "id", "other").rdd.map(lambda r: ((r.grp, 0), (bytes(r.digest), r.id, None if r.other is None else bytes(r.other))))
            last = _met(alone, roots, wide).flatMap(lambda x: told(x[1][1][0], x[1][0], x[1][1][1]))
            return last if out is None else last.union(out)
        own = nodes.select("grp", "idx", "n", "children").rdd.map(lambda r: ((r.grp, r.idx), (r.n, [(bytes(c.digest), c.id, None if c.other is None else bytes(c.other)) for c in r.children])))
        top = _met(own.filter(lambda x: x[1][0] == 1), roots, wide).mapValues(lambda v: (v[0][1], v[1]))
        rest = own.filter(lambda x: x[1][0] > 1)
        heard = top if above is None else top.union(_met(rest, above, wide).mapValues(lambda v: (v[0][1], v[1])))

        def pass_on(item: tuple, level: int = level) -> Iterator[tuple]:
            (grp, idx), (children, (start, path)) = item
            run = tuple(c[0] for c in children)
            for i, child in enumerate(children):
                if level == 1:
                    yield from told(start, child, ((i, run), *path))
                else:
                    yield (grp, idx * fan + i), (start, ((i, run), *path))

        if level == 1:
            out = heard.flatMap(pass_on)
        else:
            above = heard.flatMap(pass_on)
    raise AssertionError("a tree has leaves")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A row's leaf is the digest of its ``columns``. The leaves of a group, by id, make
    up its tree; the groups' roots, by group, make up one more. Each leaf is sent the
    digests beside its path to the root and folds them: a tampered copy of the row,
    made where TAMPER divides the checksum of its id, does not give the root.

    Defined cases: nulls are hashed as ``-``; a null group is a group, before all
    others; a null id stands before the others and is not tampered with; rows of one
    id stand by their digests, and equal rows each are a leaf; empty and very long
    texts are hashed whole; a text without A-Z is the same when tampered with, and is
    verified; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    values = [docs[c] for c in columns]
    tampered = F.pmod(F.crc32(docs[id_col].cast("string")), F.lit(TAMPER)) == 0
    other = F.when(tampered, leaf_digest([lowered(docs[c]) if c == text_col else docs[c] for c in columns]))
    rows = stored(docs.select(docs[group_col].cast("string").alias("grp"), docs[id_col].alias("id"), leaf_digest(values).alias("digest"), other.alias("other")))
    inner = climb(numbered(rows, ["grp", "id", "digest"], "grp").select("grp", "idx", "n", "digest", "id", "other"))
    subroots = numbered(inner.roots().withColumnRenamed("grp", "id"), ["id"])
    outer = climb(subroots.select(F.lit("").alias("grp"), "idx", "n", "digest", "id", F.lit(None).cast("binary").alias("other")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    top = outer.roots().first()
    if top is None:
        return spark.createDataFrame([], schema)
    root = bytes(top.digest)
    starts = descend(outer, spark.sparkContext.parallelize([("", (None, ()))], 1), lambda _, leaf, path: iter([(leaf[1], (leaf[0], path))]))

    def rows_of(subroot: bytes, leaf: tuple, path: Path) -> Iterator[tuple]:
        digest, name, changed = leaf
        folded = fold(digest if changed is None else changed, path)
        yield name, digest.hex(), subroot.hex(), root.hex(), proof(path).hex(), folded.hex(), folded == root

    return spark.createDataFrame(descend(inner, starts, rows_of), schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as leaves of one manifest, with their proofs and verification."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
