"""Distributed order statistics by repeated histograms; no sort and no single task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins that one round sums for all groups together; the driver sees at most so many sums, or two a group.
BINS = 1 << 18


def small_table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """Whole numbers that the driver knows, a row each, as a frame to join with; its size is theirs."""
    literal = F.from_json(F.lit(json.dumps(rows)), "array<array<long>>")
    one = spark.range(1).select(F.explode(literal).alias("r"))
    return F.broadcast(one.select(*[F.col("r")[i].alias(n) for i, n in enumerate(names)]))


def cut_points(
    rows: DataFrame,
    group: Column,
    key: Column,
    weight: Column,
    wanted: dict[int, tuple[int, int, float]],
    slack: dict[int, float] | None = None,
    bin_bits: int = 12,
) -> dict[int, tuple[int, float]]:
    """For each group the integer cut whose lower side weighs nearest to what is wanted.

    ``wanted`` maps a group to (lowest key, highest key, weight). Each round sums at
    most ``2**bin_bits`` bins for each group on the executors (fewer where there are
    many groups) and narrows the group to the bin that straddles its target, until
    that bin is one key wide or weighs no more than ``slack``. The groups' bounds are
    a table that is joined, so the plan does not grow with them. The driver sees at
    most BINS sums a round, or two a group. Returns (cut, weight below it); the rows
    with key < cut are the lower side.
    """
    slack, done = slack or {}, {}
    open_ = {g: (lo, hi + 1, 0.0) for g, (lo, hi, _) in wanted.items()}
    keyed = rows.select(group.cast("long").alias("g"), key.cast("long").alias("k"), weight.alias("w"))
    while open_:
        bits = max(1, min(bin_bits, (BINS // len(open_)).bit_length() - 1))
        shift = {g: max(0, (hi - lo - 1).bit_length() - bits) for g, (lo, hi, _) in open_.items()}
        bounds = small_table(rows.sparkSession, [(g, lo, hi, shift[g]) for g, (lo, hi, _) in open_.items()], "g", "lo", "hi", "by")
        inside = keyed.join(bounds, "g").where("k >= lo and k < hi")
        sums: dict[int, list[tuple[int, float]]] = {g: [] for g in open_}
        for r in inside.groupBy("g", F.call_function("shiftright", F.col("k") - F.col("lo"), F.col("by").cast("int")).alias("b")).agg(F.sum("w").alias("w")).collect():
            sums[r.g].append((int(r.b), float(r.w)))
        narrowed = {}
        for g, (lo, hi, below) in open_.items():
            target, at = wanted[g][2], None
            for b, w in sorted(sums[g]):
                if below + w > target:
                    at = (b, w)
                    break
                below += w
            if at is None:
                done[g] = (hi, below)
                continue
            left = lo + (at[0] << shift[g])
            right = min(hi, left + (1 << shift[g]))
            if right - left > 1 and at[1] > slack.get(g, 0.0):
                narrowed[g] = (left, right, below)
            elif below + at[1] - target <= target - below:
                done[g] = (right, below + at[1])
            else:
                done[g] = (left, below)
        open_ = narrowed
    return done
