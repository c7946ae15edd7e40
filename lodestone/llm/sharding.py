"""Minimax contiguous sharding (operator 9, native).

Rows with equal texts form an atomic group; groups stand in the order of a 60-bit key taken from the
text's SHA-256. The smallest capacity for which a greedy walk over the ordered group sizes needs at most
``shards`` shards is found by binary search, and the order is cut where that walk cuts.

No task and no driver ever holds all group sizes. The driver sees sums over key prefixes ("segments"):
first 4,096 of them, then, only where a cut may fall, finer ones. A walk that may cut anywhere inside a
segment gives a lower bound of the capacity, one that may cut at segment borders only an upper bound;
segments that keep the bounds apart are split further until both agree. So the result is exact, and what
the driver holds depends on ``shards`` and the key's width, not on the rows. One key, however many rows
share it, is a single number.

Law: ``bytes``. Defined results: a null text counts as empty (size 1); null and repeated ids keep their rows;
an empty table gives no rows; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, whole_text

SHARDS = 16
KEY_BITS, FIRST_BITS, MORE_BITS = 60, 12, 8


def _walk(starts: list[int], sums: list[int], solid: list[bool], capacity: int, most: int) -> tuple[list[int], bool]:
    """Greedy cuts (as positions in bytes) and whether ``most`` shards hold all. Where a segment isn't solid a cut may fall inside it."""
    total, at, cuts = starts[-1] + sums[-1], 0, []
    for _ in range(most):
        if at + capacity >= total:
            return cuts, True
        k = bisect_right(starts, at + capacity) - 1
        to = starts[k] if solid[k] else at + capacity
        if to <= at:
            return cuts, False
        cuts.append(at := to)
    return cuts, False


def _smallest(starts, sums, solid, shards: int, low: int) -> int:
    high = starts[-1] + sums[-1]
    low = min(max(low, -(-high // shards)), high)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _walk(starts, sums, solid, mid, shards)[1] else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity and the first key of the 2nd, 3rd ... shard; ``groups`` has (key, bytes), one row for each key."""

    def sums_by(bits: int, inside: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        rows = groups
        if inside:
            tops: dict[int, list[int]] = {}
            for prefix, old in inside:
                tops.setdefault(old, []).append(prefix)
            where = [F.shiftright("key", KEY_BITS - old).isin(xs) for old, xs in tops.items()]
            rows = rows.where(_any(where))
        got = rows.groupBy(F.shiftright("key", KEY_BITS - bits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        return [(r.p, bits, int(r.b), r.n) for r in got.collect()]  # bounded: see the module's text

    segments = sums_by(FIRST_BITS, [])
    if not segments:
        return 0, []
    while True:
        segments.sort(key=lambda s: s[0] << (KEY_BITS - s[1]))
        sums = [s[2] for s in segments]
        starts = [0, *accumulate(sums)][:-1]
        atoms = [s[3] == 1 for s in segments]
        least = max((b for b, a in zip(sums, atoms) if a), default=1)
        low = _smallest(starts, sums, atoms, shards, least)
        high = _smallest(starts, sums, [True] * len(sums), shards, low)
        if low == high:
            cuts, _ = _walk(starts, sums, [True] * len(sums), high, shards)
            at = {x: k for k, x in enumerate(starts)}
            return high, [segments[at[c]][0] << (KEY_BITS - segments[at[c]][1]) for c in cuts]
        touched = set()
        for capacity, solid in ((low, atoms), (high, atoms), (high, [True] * len(sums))):
            for c in _walk(starts, sums, solid, capacity, shards)[0]:
                k = bisect_right(starts, c) - 1
                touched |= {i for i in (k - 1, k, k + 1) if 0 <= i < len(sums) and not atoms[i]}
        finer: dict[int, list[tuple[int, int]]] = {}
        for i in touched:
            finer.setdefault(min(KEY_BITS, segments[i][1] + MORE_BITS), []).append(segments[i][:2])
        segments = [s for i, s in enumerate(segments) if i not in touched]
        for bits, inside in finer.items():
            segments += sums_by(bits, inside)


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
            F.spark_partition_id().alias("split"),
        ),
        "sizes",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, firsts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("key") >= F.lit(first)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    # slots: counts of each shard in each input split, summed in split order, then a place in the split
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy("shard").orderBy("split")) - F.col("n")).alias("before")
    counts = counts.select("shard", "split", before)
    own = F.row_number().over(Window.partitionBy("shard", "split").orderBy("doc_id", "key", "size")) - 1
    return (
        placed.withColumn("own", own)
        .join(counts, ["shard", "split"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
