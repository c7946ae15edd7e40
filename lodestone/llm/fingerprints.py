"""Improbable-feature digests of documents (operator 1).

A digest keeps the byte windows that are least expected in a text. Each window's Shannon entropy falls in one of
1,001 classes; a class is the more improbable the fewer windows of the whole corpus lie in it (counted in one pass
over all texts, 1,001 sums for each scale). Every stretch of neighbouring windows votes for its leftmost rarest
one; windows with ``share`` of a stretch's votes are the text's features. Features are hashed into a chain of
2,048-bit Bloom filters, five bits each, 160 features to a filter. Likeness is the mean, weighted by set bits, over
the shorter chain's filters of the best normalised bit overlap: 0 at what chance gives, 1 at one inside the other.

Two scales: windows of 32 bytes for texts of 192 bytes or more, windows of 8 bytes for all; two digests are compared at the
largest scale both have, so there is no length at which like texts can't be compared.

Defined results: a null text is empty; an empty text's fingerprint is "" and like only to another empty one (1, else
0); the last document's next is the first, a lone document's is itself; null ids sort first; repeated ids stand in
text order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import order_key, ordered_buckets, table, whole_text

SCALES = (32, 8)
LARGE_FROM = 192
VOTES_SHARE = 4  # a feature has a quarter of a stretch's votes
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
CLASSES = 1001
DULL = 100  # entropy classes below this come last whatever their number
_ONE = 1 << 16
_NONE = np.iinfo(np.int64).max


def _layout(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each after ``width`` zeros; where they start; how many windows each has."""
    pad = bytes(width)
    buffer = np.frombuffer(b"".join([x for t in texts for x in (pad, t)] + [pad * 2]), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(n + width) - n
    return buffer, starts, np.where(n > 0, np.maximum(n - width + 1, 1), 0)


def entropy_classes(buffer: np.ndarray, width: int) -> np.ndarray:
    """Class (0 to 1000) of the entropy of the window that starts at each byte but the last ``width``."""
    before, after = np.zeros(len(buffer), np.uint8), np.zeros(len(buffer), np.uint8)
    for d in range(1, width):  # equal bytes at distance d
        same = (buffer[d:] == buffer[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    c = np.arange(width + 1, dtype=np.float64)
    g = np.round(c * np.log2(np.maximum(c, 1)) * _ONE).astype(np.int64)
    step = np.diff(g)  # what the next equal byte adds
    first = int(g[np.bincount(buffer[:width], minlength=1)].sum())
    sums = np.empty(len(buffer) - width, np.int64)
    sums[0] = first
    np.cumsum(step[before[width:-1]] - step[after[: -width - 1]], out=sums[1:])
    sums[1:] += first
    return ((g[width] - sums) * (CLASSES - 1)) // int(g[width])


def _valid(size: int, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, starts, (windows > 0).astype(np.int32))
    np.add.at(mark, starts + windows, -(windows > 0).astype(np.int32))
    return np.cumsum(mark[:-1]) > 0


def class_counts(texts: list[bytes], width: int) -> np.ndarray:
    """How many windows of the texts lie in each class."""
    buffer, starts, windows = _layout(texts, width)
    classes = entropy_classes(buffer, width)
    return np.bincount(classes[_valid(len(classes), starts, windows)], minlength=CLASSES)


def ranks(counted: np.ndarray) -> np.ndarray:
    """Rank of each class, the most improbable first."""
    order = sorted(range(CLASSES), key=lambda k: (k < DULL, counted[k], -k))
    out = np.empty(CLASSES, np.int64)
    out[order] = np.arange(CLASSES)
    return out


def _hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit mixes of equally long byte windows (rows)."""
    h = np.full(len(windows), 0x9E3779B97F4A7C15, np.uint64)
    for lane in np.ascontiguousarray(windows).view("<u8").T:
        h = (h ^ lane) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


def features(texts: list[bytes], width: int, rank: np.ndarray) -> list[np.ndarray]:
    """For each text the hashes of its features, in text order, without repeats."""
    buffer, starts, windows = _layout(texts, width)
    classes = entropy_classes(buffer, width)
    at = np.arange(len(classes), dtype=np.int64)
    key = np.where(_valid(len(classes), starts, windows), (rank[classes] << 40) | at, _NONE)
    least, span = np.concatenate([np.full(width - 1, _NONE), key]), 1
    while span < width:  # least[i]: of the ``width`` windows that end at i
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    votes = np.bincount(least[: len(key)][least[: len(key)] != _NONE] & ((1 << 40) - 1), minlength=len(classes))
    picked = np.flatnonzero(votes >= max(1, width // VOTES_SHARE))
    hashed = _hashes(np.lib.stride_tricks.sliding_window_view(buffer, width)[picked]) if len(picked) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(picked, np.append(starts, len(buffer)))
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        _, first = np.unique(hashed[lo:hi], return_index=True)
        out.append(hashed[lo:hi][np.sort(first)])
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters (rows of 64-bit words) that hold the features, ``PER_FILTER`` to each."""
    filters = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((filters, FILTER_BITS), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


Digest = dict[int, np.ndarray]


def digests(texts: list[str], rank: dict[int, np.ndarray]) -> list[Digest]:
    """scale -> chain for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[Digest] = [{} for _ in raw]
    for width in SCALES:
        mine = [i for i, x in enumerate(raw) if x and (len(x) >= LARGE_FROM or width != SCALES[0])]
        if mine:
            for i, h in zip(mine, features([raw[i] for i in mine], width, rank[width])):
                out[i][width] = chain(h)
    return out


def written(digest: Digest) -> str:
    return "|".join(f"{w}:" + base64.b64encode(c.tobytes()).decode() for w, c in digest.items())


def likeness(a: Digest, b: Digest) -> float:
    """0 (as by chance) to 1."""
    if not a or not b:
        return float(not a and not b)
    width = next((w for w in SCALES if w in a and w in b), None)
    if width is None:
        return 0.0
    x, y = sorted((a[width], b[width]), key=lambda c: (len(c), int(np.bitwise_count(c).sum()), c.tobytes()))
    ones_x, ones_y = (np.bitwise_count(c).sum(axis=1).astype(np.float64) for c in (x, y))
    best = np.zeros(len(x))
    for i, row in enumerate(x):
        shared = np.bitwise_count(y & row).sum(axis=1)
        chance, most = ones_x[i] * ones_y / FILTER_BITS, np.minimum(ones_x[i], ones_y)
        best[i] = max(0.0, float(((shared - chance) / np.maximum(most - chance, 1e-9)).max()))
    return min(1.0, float((best * ones_x).sum() / ones_x.sum()))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the next text (all, if it is shorter)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _slices(texts: list, most_rows: int = 256, most_chars: int = 1 << 20):
    lo, held = 0, 0
    for hi, t in enumerate(texts):
        if hi > lo and (hi - lo >= most_rows or held + len(t) > most_chars):
            yield lo, hi
            lo, held = hi, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        sums = {w: np.zeros(CLASSES, np.int64) for w in SCALES}
        texts = batch.column("text").to_pylist()
        for lo, hi in _slices(texts):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
            sums[SCALES[0]] += class_counts([x for x in raw if len(x) >= LARGE_FROM], SCALES[0])
            sums[SCALES[1]] += class_counts(raw, SCALES[1])
        rows = [(w, k, int(n)) for w, s in sums.items() for k, n in enumerate(s) if n]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["width", "class", "n"])


def corpus_ranks(docs: DataFrame) -> dict[int, np.ndarray]:
    """Class ranks of each scale from all texts; at most 1,001 sums for each reach the driver."""
    counted = docs.select(whole_text().alias("text")).mapInArrow(_count, "width int, class int, n long")
    sums = {w: np.zeros(CLASSES, np.int64) for w in SCALES}
    for r in counted.groupBy("width", "class").agg(F.sum("n").alias("n")).collect():
        sums[r.width][r["class"]] = r.n
    return {w: ranks(s) for w, s in sums.items()}


def _digest(rank: dict[int, np.ndarray]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [written(d) for lo, hi in _slices(texts) for d in digests(texts[lo:hi], rank)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, rank: dict[int, np.ndarray] | None = None) -> DataFrame:
    """doc_id and fingerprint of each document; ``rank`` from an earlier corpus makes digests comparable with its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_digest(rank or corpus_ranks(docs)), "doc_id long, fingerprint string")


def _pairs(rank: dict[int, np.ndarray]):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        import pyarrow as pa

        last = None  # (bucket, guest, id, text, digest)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")]
            for lo, hi in _slices(columns[3]):
                rows = list(zip(*(c[lo:hi] for c in columns)))
                own = digests([r[3] for r in rows], rank)
                line = ([last] if last else []) + [(*r, d) for r, d in zip(rows, own)]
                last = line[-1]
                # an own row is always followed by a row of its bucket: another own one or its guest
                pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1] and a[0] == b[0]]
                changed = [edited(a[3], b[3]) for a, b in pairs]
                out = [
                    (a[2], len(a[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), written(a[4]), written(d), likeness(a[4], d), likeness(a[4], b[4]))
                    for (a, b), e, d in zip(pairs, changed, digests(changed, rank))
                ]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return run


def next_and_edited(docs: DataFrame, rank: dict[int, np.ndarray]) -> DataFrame:
    """Each document against its edited text and the next document. The text is shuffled once, by ranges of the id;
    each range also gets the document that follows it."""
    key = order_key()
    bucket, parts, bounds = ordered_buckets(docs, key)
    first = docs.agg(F.min(key).alias("k")).first().k
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    own = place(bucket, 0)
    at = F.when(key == F.lit(first), F.array(own, place(F.lit(len(bounds)), 1))).when(key.isin(bounds), F.array(own, place(bucket - 1, 1))) if bounds else F.when(key == F.lit(first), F.array(own, place(F.lit(0), 1)))
    rows = docs.select(F.explode(at.otherwise(F.array(own))).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.select("at.bucket", "at.guest", "doc_id", "text").repartitionById(parts, "bucket")
    rows = rows.sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(_pairs(rank), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return next_and_edited(docs, corpus_ranks(docs))
