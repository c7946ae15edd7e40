"""Supervised subword embeddings (operator 10).

Words and character n-grams, those within words and those that reach over the space between two words, are hashed
to learned vectors; a document is the mean of all these vectors, a softmax layer gives the probability of good
quality. Both are trained by numpy stochastic gradient descent with steps scaled by each vector's past gradients.

Training takes a bounded sample: the ``SAMPLE`` labelled rows with the smallest id hash (all of them if there are
fewer), whole texts, and of these, in that order, as many as have ``FEATURES`` different features together. Texts are
hashed where they lie, so the driver gets at most ``FEATURES`` bucket numbers and counts. Rows held out by the
caller never enter.

Scoring is linear in a document's features: workers cut about 256 KB of text at a time into words and n-grams with numpy,
find all their buckets at once (CRCs are affine, so a short gram's is an exclusive-or of table entries) and add up
the logits of each document. The model is a fixed-size array (``BUCKETS`` floats after folding the output layer in) that
travels with the task.

Defined results: a null or empty text has no words and gets the trained bias alone; rows with a null label,
null id or an id without a document don't train; repeated labels train repeatedly; without any usable label
every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, lean, stored, table, whole_text

BUCKETS, WIDTH = 1 << 16, 8
GRAM_LENGTHS = (3, 4)
EPOCHS, RATE, SEED = 12, 0.2, 5
SAMPLE, FEATURES = 3000, 12_000_000
#: Features of no weight that every document has: a very short text stays near the bias.
SMOOTH = 20


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of the word itself and of the character n-grams of ``<word>``; long words' n-grams are all used."""
    framed = f"<{word}>"
    return [_bucket(g) for g in (framed, *(framed[i : i + n] for n in GRAM_LENGTHS for i in range(len(framed) - n + 1)))]


def across(ends: str) -> list[int]:
    """Buckets of the n-grams (two to four characters) that hold the space of "last two characters, space, first two"."""
    at = ends.index(" ")
    return [_bucket(ends[i:j]) for i in range(max(0, at - 2), at + 1) for j in range(at + 1, len(ends) + 1) if 2 <= j - i <= 4]


#: A CRC is affine: what a byte with k bytes behind it adds to a message's bucket, and the bucket of n zero bytes.
_LONG = 32
_ADDS = np.array([[(zlib.crc32(bytes([b]) + bytes(k)) ^ zlib.crc32(bytes(k + 1))) % BUCKETS for b in range(256)] for k in range(_LONG)], np.uint16)
_ZEROS = np.array([zlib.crc32(bytes(n)) % BUCKETS for n in range(_LONG + 1)], np.uint16)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]").search
#: Bytes of text whose features are made at once.
PART = 1 << 18


def _buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Buckets of the spans of ``data``, many at a time."""
    out = _ZEROS[np.minimum(lengths, _LONG)]
    for n in np.flatnonzero(np.bincount(np.minimum(lengths, _LONG + 1), minlength=_LONG + 2)[: _LONG + 1]).tolist():
        own = np.flatnonzero(lengths == n)
        at = starts[own]
        x = _ADDS[n - 1][data[at]]
        for k in range(1, n):
            x ^= _ADDS[n - 1 - k][data[at + k]]
        out[own] ^= x
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]]) % BUCKETS
    return out


def _char_starts(data: np.ndarray) -> np.ndarray:
    """Offsets of the characters of UTF-8, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def all_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all texts' words and of what reaches over the spaces between these, and each one's text:
    as ``features`` of each word and ``across`` of each two neighbours' ends give them."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = ~_IS_SPACE[raw]
    first = np.flatnonzero(keep & ~np.concatenate([[False], keep[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    text_of = np.searchsorted(ends, first, "right")
    held = raw[keep]
    n_bytes = np.diff(np.append((np.cumsum(keep) - 1)[first], len(held)))
    word = np.repeat(np.arange(len(first)), n_bytes)
    n_chars = np.bincount(word[(held & 0xC0) != 0x80], minlength=len(first))
    places = np.arange(len(held))

    # <word><word>...
    data = np.empty(len(held) + 2 * len(first), np.uint8)
    stops = np.cumsum(n_bytes + 2)
    begins = stops - n_bytes - 2
    data[begins], data[stops - 1] = ord("<"), ord(">")
    data[places + 2 * word + 1] = held
    at = _char_starts(data)
    left = np.repeat(np.cumsum(n_chars + 2), n_chars + 2) - np.arange(len(at) - 1)  # characters of the word from here
    text_of_char = np.repeat(text_of, n_chars + 2)
    found, whose = [_buckets(data, begins, n_bytes + 2)], [text_of]
    for n in GRAM_LENGTHS:
        i = np.flatnonzero(left >= n)
        found.append(_buckets(data, at[i], at[i + n] - at[i]))
        whose.append(text_of_char[i])

    # word word ...
    data = np.full(len(held) + len(first), ord(" "), np.uint8)
    data[places + word] = held
    at = _char_starts(data)
    meet = np.flatnonzero(text_of[1:] == text_of[:-1])
    space = (np.cumsum(n_chars + 1) - 1)[meet]
    for before, after in ((0, 1), (0, 2), (1, 0), (2, 0), (1, 1), (2, 1), (1, 2)):
        own = (n_chars[meet] >= before) & (n_chars[meet + 1] >= after)
        i = space[own] - before
        found.append(_buckets(data, at[i], at[i + before + 1 + after] - at[i]))
        whose.append(text_of[meet[own]])
    return np.concatenate(found), np.concatenate(whose)


def _in_parts(texts: Iterable[bytes]):
    """(text's place, piece, features beside those of the piece): long texts are cut at spaces; what reaches over the cuts comes along."""
    for k, text in enumerate(texts):
        lo, last = 0, b""
        while True:
            cut = _SPACE(text, lo + PART) if len(text) - lo > PART else None
            piece = text[lo : cut.start()] if cut else text[lo:]
            more = []
            if (lo or cut) and (words := piece.split(None, 1)):
                if last:
                    more = across(f"{last.decode()[-2:]} {words[0].decode()[:2]}")
                last = piece.rsplit(None, 1)[-1]
            yield k, piece, more
            if not cut:
                break
            lo = cut.end()


def features_of(texts: Iterable[bytes]):
    """Arrays (features' buckets, places of their texts), for about ``PART`` bytes at a time, in the texts' order."""
    places, pieces, more, held = [], [], ([], []), 0
    for k, piece, own in _in_parts(texts):
        if held + len(piece) > PART and pieces:
            found, whose = all_features(pieces)
            yield np.append(found, more[0]).astype(np.int64), np.append(np.array(places, np.int64)[whose], more[1]).astype(np.int64)
            places, pieces, more, held = [], [], ([], []), 0
        places.append(k)
        pieces.append(piece)
        more[0].extend(own)
        more[1].extend([k] * len(own))
        held += len(piece)
    if pieces:
        found, whose = all_features(pieces)
        yield np.append(found, more[0]).astype(np.int64), np.append(np.array(places, np.int64)[whose], more[1]).astype(np.int64)


Docs = list[tuple[np.ndarray, np.ndarray]]


def train(docs: Docs, labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(logit of each bucket, bias): the two-class softmax's difference, the output layer folded in. docs: buckets and counts."""
    if not docs:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    output, bias = np.zeros((2, WIDTH)), np.zeros(2)
    past_vectors, past_output = np.full(BUCKETS, 1e-8), 1e-8  # squared gradients so far
    # classes weigh alike in the loss: the rare one is not drowned out
    weight = np.minimum(len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1)), 10)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            (at, counts), y = docs[k], labels[k]
            share = counts / (counts.sum() + SMOOTH)
            step = rate * (1 - done / steps)
            hidden = share @ vectors[at]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            back = p @ output
            change = np.outer(p, hidden)
            past_output += float((change * change).sum())
            output -= step * change / np.sqrt(past_output)
            bias -= 0.05 * step * p
            past_vectors[at] += share * share * float(back @ back)
            vectors[at] -= step * np.outer(share / np.sqrt(past_vectors[at]), back)
            done += 1
    difference = output[1] - output[0]
    return (vectors @ difference).astype(np.float32), float(bias[1] - bias[0])


def hashed(texts: Iterable[bytes], n_texts: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Offsets of each text's part of the others: its features' ascending buckets and how often each occurs."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for found, whose in features_of(texts):
        key, n = np.unique(whose * BUCKETS + found, return_counts=True)
        if len(key) and len(keys[-1]) and keys[-1][-1] // BUCKETS == (k := key[0] // BUCKETS):  # a long text goes on
            lo, hi = np.searchsorted(keys[-1], k * BUCKETS), np.searchsorted(key, (k + 1) * BUCKETS)
            both, at = np.unique(np.append(keys[-1][lo:], key[:hi]), return_inverse=True)
            n = np.append(np.bincount(at, np.append(counts[-1][lo:], n[:hi])).astype(np.int64), n[hi:])
            key, keys[-1], counts[-1] = np.append(both, key[hi:]), keys[-1][:lo], counts[-1][:lo]
        if len(key):
            keys.append(key)
            counts.append(n)
    key = np.concatenate(keys)
    return np.searchsorted(key, np.arange(n_texts + 1) * BUCKETS).tolist(), (key % BUCKETS).astype(np.int32), np.concatenate(counts).astype(np.int32)


def _hash(batches):
    import pyarrow as pa

    for batch in batches:
        at, *lists = hashed((x.as_py().encode() for x in batch.column("text")), batch.num_rows)
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *lists], names=["doc_id", "quality", "buckets", "counts"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> tuple[Docs, list[int]]:
    """Hashed texts and labels of at most ``sample`` labelled rows with at most ``most`` features, in the order of an id hash."""
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("quality"))
    # ids are picked before texts are touched; twice as many, as some may have no document
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(lean(_hash), "doc_id long, quality int, buckets array<int>, counts array<int>")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"), F.col("buckets"), F.col("counts")]
    rows = stored(rows, "labelled").orderBy(*order).limit(sample)  # one order over ``sample`` rows
    upto = F.sum(F.size("buckets")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("upto", upto).where(F.col("upto") <= most).orderBy(*order).select("quality", "buckets", "counts").toArrow()
    lists = [[x.values.to_numpy() for x in got.column(c).combine_chunks()] if got.num_rows else [] for c in ("buckets", "counts")]
    return list(zip(*lists)), got.column("quality").to_pylist()


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _score(logits: np.ndarray, bias: float):
    def run(batches):
        import pyarrow as pa

        weights = logits.astype(np.float64)
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for found, whose in features_of(x.as_py().encode() for x in batch.column("text")):
                total += np.bincount(whose, weights[found], len(n))
                n += np.bincount(whose, minlength=len(n))
            out = bias + total / (n + SMOOTH)
            score = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from the labels that are not held out."""
    model = train(*training_rows(docs, labels.where(~held_out()), sample))
    give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(lean(_score(*model)), "doc_id long, score double")


def _with_scores(logits: np.ndarray, bias: float, floor: float):
    scorer = _score(logits, bias)

    def run(batches):
        import pyarrow as pa

        held = []

        def plain():
            for batch in batches:
                held.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").fill_null("")], names=["doc_id", "text"])

        for scored in scorer(plain()):
            yield held.pop().filter(pa.array(scored.column("score").to_numpy() >= floor))

    return run


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], floor: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores ``floor`` or more."""
    return docs.mapInArrow(lean(_with_scores(*model, floor)), docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
