"""SimHash near-duplicate classes (operator 3).

1. Fingerprints are computed where the texts lie; from here on rows are (doc_id, fingerprint).
2. Equal fingerprints collapse to one row with their smallest doc_id.
3. Distinct fingerprints are compared in tiles: numpy exclusive-or of a tile against a tile, bit counts,
   and no comparison at all for two tiles whose population counts lie further apart than the radius.
   Which tiles can meet follows from the pigeonhole principle: of ``radius + 1`` bands of the 64 bits, two
   fingerprints within the radius share at least one, so tiles hold fingerprints of one band value. Nothing
   within the radius is missed. A band value with more fingerprints than ``PART`` is split into parts, and
   every pair of parts is a group of its own, so no task gathers an unbounded group.
4. From each comparison only links that join two still separate sets are kept (a spanning forest, so links
   never grow with the square of a group), and classes are the connected components of all of them.

A document with no words has fingerprint zero. Defined results: null texts count as empty; null ids form
classes like others and are never the smallest id unless all are null; repeated rows stay, each with its class.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole_text
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE, PART, HOT = 256, 8192, 1000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; bit k is set if over half the shingles' XXH64 (seed 42) have it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:n - 1]])
    stops = ends[min(shingle, len(words)) - 1 :][:n] - 1
    line = b" ".join(words)
    counts, step = np.zeros(64, np.int64), 1 << 16
    for lo in range(0, n, step):
        cuts = map(slice, starts[lo : lo + step].tolist(), stops[lo : lo + step].tolist())
        h = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, min(step, n - lo))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * counts > n].sum())


def _fingerprints(shingle: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            fp = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 bands that cover 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Joins linked places' sets; returns the links that were needed. parent: each place's root, kept flat."""
    used = []
    while len(a):
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
        if not len(a):
            break
        # one link for each higher root at a time: together they form a forest
        hi, lo = np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b])
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        used += zip(a[first].tolist(), b[first].tolist())
        to = np.arange(len(parent))
        to[hi[first]] = lo[first]
        while not np.array_equal(to, to[to]):
            to = to[to]
        parent[:] = to[parent]
    return used


def tile_links(fps: np.ndarray, radius: int, split: int | None = None, tile: int = TILE) -> list[tuple[int, int]]:
    """Links (as places in ``fps``) that connect what lies within the radius; with ``split``, only across the two parts."""
    parts = [np.arange(len(fps))] if split is None else [np.arange(split), np.arange(split, len(fps))]
    ones = np.bitwise_count(fps).astype(np.int64)
    tiles = []
    for part in parts:
        part = part[np.argsort(ones[part], kind="stable")]
        tiles.append([part[i : i + tile] for i in range(0, len(part), tile)])
    parent, used = np.arange(len(fps)), []
    for i, x in enumerate(tiles[0]):
        for y in tiles[0][i:] if split is None else tiles[1]:
            if max(ones[x[0]], ones[y[0]]) - min(ones[x[-1]], ones[y[-1]]) > radius:
                continue  # population counts: nothing in these two can lie within the radius
            if (parent[x[0]] == parent[x]).all() and (parent[x[0]] == parent[y]).all():
                continue  # one set already
            a, b = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= radius)
            used += _joined(parent, x[a], y[b])
    return used


def _compare(radius: int):
    def run(batches):
        import pyarrow as pa

        def close(held):
            fps, side = (np.concatenate(x) for x in zip(*held))
            held.clear()
            split = int((side == 0).sum())
            used = tile_links(fps.view(np.uint64), radius, split if 0 < split < len(side) else None)
            return [(fps[a], fps[b]) for a, b in used]

        # a group's rows are neighbours, side 0 first; a batch may end inside a group
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            band, value, pair, side, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("band", "value", "pair", "side", "fp"))
            if not len(fp):
                continue
            new = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])) + 1
            cuts, out = [0, *new.tolist(), len(fp)], []
            for lo, hi in zip(cuts, cuts[1:]):
                key = (band[lo], value[lo], pair[lo])
                if held and key != last:
                    out += close(held)
                held.append((fp[lo:hi], side[lo:hi]))
                last = key
            yield _edges(pa, out)
        if held:
            yield _edges(pa, close(held))

    return run


def _edges(pa, pairs):
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp), enough to connect all within ``radius`` bits."""
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)).alias("value")) for k, (s, m) in enumerate(_bands(radius))])
    rows = distinct.select("fp", F.explode(bands).alias("x")).select("fp", "x.band", "x.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n"))
    # values with one fingerprint have nothing to compare; larger ones are cut into parts
    sizes = sizes.where("n > 1").select("band", "value", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    rows = rows.join(sizes, ["band", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a part meets itself (side 0 only) and every other part: pair = smaller * parts + larger
    rows = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select(
        "band", "value", (F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")).alias("pair"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp",
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "band", "value", "pair").sortWithinPartitions("band", "value", "pair", "side")
    return rows.mapInArrow(_compare(radius), "a long, b long").distinct()


def classes(fp: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id from a stored table (doc_id, fp)."""
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct, radius))  # (node, root)
    member = distinct.join(found, F.col("fp") == F.col("node"))
    smallest = member.groupBy("root").agg(F.min("least").alias("least"))
    moved = found.join(smallest, "root").select(F.col("node").alias("fp"), F.col("least").alias("joined"))
    named = stored(distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("joined", "least").alias("component_id")), "named")
    # a hot fingerprint's rows stay where they are: fewer than HOT fingerprints can have a HOT-th of all rows each
    rows = named.agg(F.sum("n").alias("n")).first().n or 0
    often = F.col("n") * HOT > rows
    hot, cold = F.broadcast(named.where(often)), named.where(~often)
    rest = fp.join(F.broadcast(named.where(often).select("fp")), "fp", "left_anti").join(cold, "fp")
    return fp.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id reachable)."""
    return classes(stored(fingerprints(docs, shingle), "fingerprints"), radius)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
