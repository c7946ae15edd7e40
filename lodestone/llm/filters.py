"""Operators as filters over whole documents, for pipelines.

Rows keep all their columns. Where a filter needs a row of its own back, it marks rows in a stored table, so
null and repeated ids do no harm.

Defined results: a null text counts as empty and fails the base rules; texts without words are near copies of each other and of
nothing else; of a class the row of the smallest id stays, a null id only where all are, of equal ids the first row
stored; an empty table gives no rows; columns that are named as inner ones stay what they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, weak_rules
from .common import bucket_of, lean, stored, stored_by, whole_text
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Four 64-bit words: pairs at the least similarity differ in about 39 of 256 bits, in 48 for the shortest texts (five
#: shingles of which four are shared), unrelated texts in 128 +- 8.
WORDS = 4
#: Bits that may differ in a candidate: six standard deviations above the 48. What is linked is decided on the shingles.
RADIUS = 86
#: The same for the first half of the bits (24 and six deviations of 4.4): the other half is only counted where these are near.
HALF_RADIUS = 51
#: Shingles of one part of a class that a task may hold.
HELD = 4 << 20
#: Fingerprints are dealt by size into about PIECES pieces, of at least LEAST rows and at most MOST.
PIECES, LEAST, MOST = 40, 512, 1 << 17
_ROW, _MARK = "__kept_row", "__kept_mark"
_FP = [f"f{w}" for w in range(WORDS)]


def kept_by_rules(docs: DataFrame) -> DataFrame:
    """The rows whose text the quality rules keep: base rules and posterior probability, estimated on ``docs``."""
    rows = docs.select(F.struct("*").alias("doc_id"), whole_text().alias("text"))
    judged = weak_rules.judged(stored(weak_rules.counts(rows), "counted"))
    return judged.where("kept").select("doc_id.*")


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash from one."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the set of word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    line = b" ".join(words)
    h = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, map(slice, starts, stops)), repeat(simhash.SEED)), np.uint64, n)
    return np.unique(h)


def sketch(text: str, shingle: int = SHINGLE) -> tuple[list[int], int, int]:
    """(SimHash words, digest, size) of the set of word shingles; no words: zeros."""
    h = shingles(text, shingle)
    fp = []
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            counts += np.unpackbits(_mix(h[lo : lo + (1 << 16)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        fp.append(int(simhash._WEIGHTS[2 * counts > len(h)].sum()))
    return fp, int(_mix(h, WORDS).sum(dtype=np.uint64)), len(h)


def _sketches(shingle: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [sketch(x.as_py(), shingle) for x in batch.column("text")]
            words = np.array([g[0] for g in got], np.uint64).view(np.int64).reshape(len(got), WORDS)
            digests = pa.array(np.array([g[1] for g in got], np.uint64).view(np.int64))
            columns = [batch.column("mark"), batch.column("doc_id"), *[pa.array(words[:, w]) for w in range(WORDS)], digests, pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "doc_id", *_FP, "digest", "size"])

    return run


def _sets(shingle: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column("text")]
            columns = [batch.column(c) for c in ("node", *_FP, "root", "parts")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.list_(pa.int64()))], names=["node", *_FP, "root", "parts", "set"])

    return run


def near_links(fps: np.ndarray, size: np.ndarray, radius: int, split: int | None = None, tile: int = simhash.TILE) -> list[tuple[int, int]]:
    """As ``simhash.tile_links`` for fingerprints of several words (rows): links that connect what lies within the radius and
    can be alike by size. Tiles are skipped by population counts and by sizes."""
    parts = [np.arange(len(fps))] if split is None else [np.arange(split), np.arange(split, len(fps))]
    ones = np.bitwise_count(fps).sum(axis=1).astype(np.int64)
    tiles = []
    for part in parts:
        part = part[np.argsort(size[part], kind="stable")]
        tiles.append([part[i : i + tile] for i in range(0, len(part), tile)])
    spans = [[(size[x[0]], size[x[-1]], ones[x].min(), ones[x].max()) for x in side] for side in tiles]
    words, half = np.ascontiguousarray(fps.T), WORDS // 2
    parent, used = np.arange(len(fps)), []
    for i, x in enumerate(tiles[0]):
        small, large, few, many = spans[0][i]
        for y, (least, most, fewer, more) in zip(tiles[0][i:], spans[0][i:]) if split is None else zip(tiles[1], spans[1]):
            if large < SIMILARITY * least - 1e-6 or most < SIMILARITY * small - 1e-6 or max(few, fewer) - min(many, more) > radius:
                continue
            if (parent[x[0]] == parent[x]).all() and (parent[x[0]] == parent[y]).all():
                continue
            apart = np.zeros((len(x), len(y)), np.uint8)
            for w in range(half):
                apart += np.bitwise_count(words[w][x][:, None] ^ words[w][y][None, :])
            a, b = np.divmod(np.flatnonzero(apart <= HALF_RADIUS), len(y))
            if x is y:
                a, b = a[a < b], b[a < b]
            a, b = x[a], y[b]
            less, greater = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            open_ = (parent[a] != parent[b]) & (less >= SIMILARITY * greater - 1e-6)
            a, b = a[open_], b[open_]
            whole = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= radius
            a, b = a[whole], b[whole]
            if len(a):
                used += simhash._joined(parent, a, b)
    return used


def _near(radius: int):
    def run(batches):
        import pyarrow as pa

        def close(held):
            node, side, size, fps = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            split = int((side == 0).sum())
            return [(node[a], node[b]) for a, b in near_links(fps, size, radius, split if 0 < split < len(side) else None)]

        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, side, node, size, *words = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "side", "node", "size", *_FP))
            fps = np.stack(words, axis=1).view(np.uint64)
            new = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            cuts, out = [0, *new.tolist(), len(node)], []
            for lo, hi in zip(cuts, cuts[1:]):
                key = (x[lo], y[lo])
                if held and key != last:
                    out += close(held)
                held.append((node[lo:hi], side[lo:hi], size[lo:hi], fps[lo:hi]))
                last = key
            yield simhash._edges(pa, out)
        if held:
            yield simhash._edges(pa, close(held))

    return run


def near(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b) between nodes, enough to connect all whose fingerprints lie within ``radius`` bits and whose sizes allow the similarity.

    At this radius no bands exist that near fingerprints must share, so every tile meets every other one that sizes and
    population counts don't rule out. Pieces of neighbouring sizes are the unit that is dealt to tasks: each pair of pieces that
    can hold something alike is a group. The driver gets a row for each piece.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    rows = min(max(-(-n // PIECES), LEAST), most)
    shares = [k * rows / n for k in range(1, -(-n // rows))]
    found = nodes.agg(F.percentile_approx("size", shares, 10 * len(shares) + 1000)).first()[0] if shares else []
    dealt = nodes.withColumn("bucket", bucket_of(F.col("size"), sorted(set(found))))
    pieces = [(b.bucket, k, b.lo, b.hi) for b in sorted(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).collect()) for k in range(-(-b.n // rows))]
    lo, hi = (np.array([p[k] for p in pieces], np.float64) for k in (2, 3))
    last = np.searchsorted(lo, (hi + 1e-6) / SIMILARITY, "right") - 1  # the last piece with something large enough to be ruled out
    first = np.searchsorted(last, np.arange(len(pieces)))
    listed = [(b, k, i, int(first[i]), int(last[i])) for i, (b, k, _, _) in enumerate(pieces)]
    table = F.broadcast(spark.createDataFrame(listed, "bucket int, part int, piece int, first int, last int"))
    parts = F.broadcast(spark.createDataFrame(listed, "bucket int, part int, piece int, first int, last int").groupBy("bucket").agg(F.count("*").alias("parts")))
    dealt = dealt.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(table, ["bucket", "part"])
    dealt = dealt.select("node", "size", *_FP, "piece", F.explode(F.sequence("first", "last")).alias("other"))
    side = F.when(F.col("piece") <= F.col("other"), 0).otherwise(1)
    dealt = dealt.select(F.least("piece", "other").alias("x"), F.greatest("piece", "other").alias("y"), side.alias("side"), "node", "size", *_FP)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "x", "y").sortWithinPartitions("x", "y", "side")
    return dealt.mapInArrow(lean(_near(radius)), "a long, b long").distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets: shared elements of all; two empty sets are alike."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """As ``simhash._joined``, of candidates: those whose sets are alike. A candidate within one set already needs no look."""
    used, step = [], 16
    while len(a):
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
        known = len(used)
        for x, y in zip(a[:step].tolist(), b[:step].tolist()):
            if parent[x] != parent[y] and similarity(sets[x], sets[y]) >= SIMILARITY:
                hi, lo = max(parent[x], parent[y]), min(parent[x], parent[y])
                parent[parent == hi] = lo
                used.append((x, y))
        a, b = a[step:], b[step:]
        step = 16 if len(used) > known else 2 * step
    return used


def tile_links(fps: np.ndarray, sets: list[np.ndarray], radius: int, split: int | None, tile: int = simhash.TILE) -> list[tuple[int, int]]:
    """As ``simhash.tile_links`` for fingerprints of several words (rows); a link's shingle sets (ascending) are alike."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    parts = [np.arange(len(fps))] if split is None else [np.arange(split), np.arange(split, len(fps))]
    ones = np.bitwise_count(fps).sum(axis=1).astype(np.int64)
    tiles = []
    for part in parts:
        part = part[np.argsort(ones[part], kind="stable")]
        tiles.append([part[i : i + tile] for i in range(0, len(part), tile)])
    parent, used = np.arange(len(fps)), []
    for i, x in enumerate(tiles[0]):
        for y in tiles[0][i:] if split is None else tiles[1]:
            if max(ones[x[0]], ones[y[0]]) - min(ones[x[-1]], ones[y[-1]]) > radius:
                continue
            if (parent[x[0]] == parent[x]).all() and (parent[x[0]] == parent[y]).all():
                continue
            apart = np.zeros((len(x), len(y)), np.uint16)
            for w in range(fps.shape[1]):
                apart += np.bitwise_count(fps[x, w][:, None] ^ fps[y, w][None, :])
            less, more = np.minimum(size[x][:, None], size[y][None, :]), np.maximum(size[x][:, None], size[y][None, :])
            near = (apart <= radius) & (less >= SIMILARITY * more - 1e-6)  # sizes further apart than that can't be alike
            a, b = np.nonzero(np.triu(near, 1) if x is y else near)
            likely = np.argsort(apart[a, b], kind="stable")
            used += _joined(parent, x[a[likely]], y[b[likely]], sets)
    return used


def _compare(radius: int):
    def run(batches):
        import pyarrow as pa

        def close(held):
            node, side, fps = (np.concatenate([h[k] for h in held]) for k in range(3))
            sets = [x for h in held for x in h[3]]
            held.clear()
            split = int((side == 0).sum())
            return [(node[a], node[b]) for a, b in tile_links(fps, sets, radius, split if 0 < split < len(side) else None)]

        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            root, pair, side, node, *words = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("root", "pair", "side", "node", *_FP))
            fps = np.stack(words, axis=1).view(np.uint64)
            ends, own = batch.column("set").offsets.to_numpy().tolist(), batch.column("set").values.to_numpy().view(np.uint64)
            sets = [own[lo:hi] for lo, hi in zip(ends, ends[1:])]
            new = np.flatnonzero((root[1:] != root[:-1]) | (pair[1:] != pair[:-1])) + 1
            cuts, out = [0, *new.tolist(), len(node)], []
            for lo, hi in zip(cuts, cuts[1:]):
                key = (root[lo], pair[lo])
                if held and key != last:
                    out += close(held)
                held.append((node[lo:hi], side[lo:hi], fps[lo:hi], sets[lo:hi]))
                last = key
            yield simhash._edges(pa, out)
        if held:
            yield simhash._edges(pa, close(held))

    return run


def _links(nodes: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, radius: int, part: int = simhash.PART) -> DataFrame:
    """(a, b) between nodes, enough to connect all of one SimHash class (``found``: node, root) whose shingles are alike.

    Shingle sets are made again, from ``texts`` (node, text), for nodes in a class with others, and go with them once, or as
    often as a class has parts.
    """
    member = nodes.join(found, "node")
    sizes = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("n") / part, F.col("held") / HELD, F.lit(1))).cast("int").alias("parts"))
    rows = texts.join(member.join(sizes, "root").select("node", *_FP, "root", "parts"), "node").select("node", *_FP, "root", "parts", "text")
    rows = rows.mapInArrow(lean(_sets(shingle)), f"node long, {', '.join(f'{f} long' for f in _FP)}, root long, parts int, set array<long>")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    rows = rows.select("root", pair.alias("pair"), side.alias("side"), "node", *_FP, "set")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "root", "pair").sortWithinPartitions("root", "pair", "side")
    return rows.mapInArrow(lean(_compare(radius)), "a long, b long").distinct()


def one_of_each_class(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each class of near copies (word shingles' similarity 0.8 or more), that of the smallest doc_id.

    The method of ``simhash`` at 256 bits: fingerprints are compared in tiles by exclusive-or and bit counts, tile pairs are
    skipped by population counts (and by set sizes), and classes are the components of the links. A radius that holds all
    pairs of this similarity also holds less similar ones, so an exact check follows inside each SimHash class: rows that
    go are joined to the one that stays by links of which each has that similarity, counted on the shingle sets.
    """
    marked = stored_by(docs.select(F.struct("*").alias(_ROW), F.monotonically_increasing_id().alias(_MARK)), _MARK, "marked")
    texts = marked.select(F.col(_MARK).alias("mark"), F.col(f"{_ROW}.doc_id").cast("long").alias("doc_id"), whole_text(f"{_ROW}.text").alias("text"))
    sketches = stored(texts.mapInArrow(lean(_sketches(shingle)), f"mark long, doc_id long, {', '.join(f'{f} long' for f in _FP)}, digest long, size long"), "sketches")
    # equal sets (copies, however many) are one node
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best")
    nodes = stored(sketches.groupBy(*_FP, "digest", "size").agg(F.min("mark").alias("node"), best), "nodes")
    candidates = stored(components(near(nodes, radius)), "candidates")
    found = components(_links(nodes, candidates, texts.select(F.col("mark").alias("node"), "text"), shingle, radius))
    classes = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("best").alias("best"))
    keep = classes.select(F.col("best.mark").alias(_MARK))
    return marked.join(keep, _MARK, "left_semi").select(f"{_ROW}.*")
