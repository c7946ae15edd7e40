"""Byte-level BPE in DuckDB, one database per worker (operator 7).

Encoding: the pattern's matches ("words") that a worker hasn't met go into a table of token positions (word, pos,
id), one row for each byte. A recursive query joins neighbouring positions with the merge table (left, right -> id,
which is also the rank) and contracts each word's leftmost pair of least rank until no word has a pair left. It
runs ``DEPTH`` contractions at a time (fewer rows: as many more) and goes on from there with the words not yet done, so what
the recursion keeps is bounded, as are the rows that go in at once.

Words over ``WINDOW`` bytes are contracted in windows that overlap by half, each distinct one once. Two neighbours are joined at
a token that both have at the same place. That is exact: if two neighbouring tokens stay apart when contracted by
themselves, and so for every pair of a sequence, then no merge ever crosses any of the boundaries, whatever
the word's length; each pair of the joined sequence stands side by side in some window. Where neighbours have no
token in common (rows of equal characters) they are contracted again in windows ``WIDER`` times as long, at last as
one; these wide windows use a second query, which contracts every occurrence of the least pair in one step where
no merge of the new token has a lower rank - leftmost-first would do just that.

Decoding: the ids of many documents in a row join the vocabulary, ``ROWS`` at a time, and an ordered aggregation puts their
bytes together; documents are cut from these by their tokens' sizes.

Words repeat, so each worker keeps a bounded memo of their ids; documents are put together from it.
Defined results: a null text is empty (no ids, no bytes); special tokens' strings are ordinary text; repeated rows,
null ids: kept as they are; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

WINDOW, WIDER = 64, 12  # the product holds whole periods of two and three bytes
DEPTH, ROWS, KEPT = 16, 1 << 18, 500_000
PIECE = 4096  # ids of a group for decoding

#: A position is word << 20 | offset, a pair left << 20 | right. Each position knows its right neighbour and what is
#: there (-1: the word ends), so a contraction drops one row and changes two.
STEP = """
WITH RECURSIVE t(step, spot, id, right_spot, right_id) AS (
    SELECT 0, spot, id, right_spot, right_id FROM seed
  UNION ALL (
    WITH b AS (
      SELECT t.spot >> 20 AS w, min((m.id << 20) | (t.spot & 1048575)) AS least, arg_min(t.right_spot, (m.id << 20) | (t.spot & 1048575)) AS gone
      FROM t JOIN merges m ON m.pair = ((t.id << 20) | t.right_id) WHERE t.step < $depth AND t.right_id >= 0 GROUP BY t.spot >> 20),
    c AS (
      SELECT b.w, (b.w << 20) | (b.least & 1048575) AS spot, b.least >> 20 AS id, b.gone, r.right_spot, r.right_id
      FROM b JOIN t r ON r.spot = b.gone)
    SELECT t.step + 1, t.spot, CASE WHEN t.spot = c.spot THEN c.id ELSE t.id END,
      CASE WHEN t.spot = c.spot THEN c.right_spot ELSE t.right_spot END,
      CASE WHEN t.spot = c.spot THEN c.right_id WHEN t.right_spot = c.spot THEN c.id ELSE t.right_id END
    FROM t JOIN c ON c.w = t.spot >> 20 WHERE t.spot <> c.gone))
SELECT step, spot, id FROM t
"""
LONG_STEP = """
WITH RECURSIVE t(step, spot, w, id) AS (
    SELECT 0, spot, w, id FROM seed
  UNION ALL (
    WITH n AS (
      SELECT step, spot, w, id, lead(id) OVER p AS rid, row_number() OVER p AS k FROM t WHERE step < $depth WINDOW p AS (PARTITION BY w ORDER BY spot)),
    c AS (SELECT n.w, n.k, m.id, m.safe, min(m.id) OVER (PARTITION BY n.w) AS least FROM n JOIN merges m ON m.pair = ((n.id << 20) | n.rid)),
    h AS (SELECT w, k, id, safe, row_number() OVER (PARTITION BY w ORDER BY k) AS nth FROM c WHERE id = least),
    g AS (SELECT w, k, id, safe, nth, row_number() OVER (PARTITION BY w, k - nth ORDER BY k) AS in_run FROM h),
    x AS (SELECT w, k, id FROM g WHERE IF(safe, in_run % 2 = 1, nth = 1))
    SELECT n.step + 1, n.spot, n.w, coalesce(a.id, n.id)
    FROM n JOIN (SELECT DISTINCT w FROM x) d ON d.w = n.w LEFT JOIN x a ON a.w = n.w AND a.k = n.k LEFT JOIN x z ON z.w = n.w AND z.k = n.k - 1
    WHERE z.k IS NULL))
SELECT step, spot, id FROM t
"""
JOINED = "SELECT string_agg(v.shown, '' ORDER BY pos) AS shown FROM pieces JOIN vocab v USING (id) GROUP BY p ORDER BY p"


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by id from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip())]
    tokens = [b""] * (max(k for k, _ in pairs) + 1)
    for k, token in pairs:
        tokens[k] = token
    return tokens


def _parts(keys: list, most: int):
    """Keys in runs of at most ``most`` characters or bytes, one at least."""
    ends, lo = list(accumulate(map(len, keys))), 0
    while lo < len(keys):
        hi = max(lo + 1, bisect_right(ends, (ends[lo - 1] if lo else 0) + most))
        yield keys[lo:hi]
        lo = hi


def _windows(lo: int, hi: int, width: int) -> list[tuple[int, int]]:
    """Spans of ``width`` that overlap by half and cover lo to hi."""
    return [(a, min(a + width, hi)) for a in range(lo, max(lo + 1, hi - width // 2), width // 2)]


class Codec:
    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa
        import regex
        from public_tokenizers import PATTERN

        self.pa, self.words = pa, regex.compile(PATTERN).findall
        tokens = read_ranks(path)
        ids = {t: k for k, t in enumerate(tokens) if t}
        merges = [(ids[t[:i]], ids[t[i:]], k) for t, k in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
        unsafe = {x for left, right, k in merges for x in (left, right) if k < x}
        self.decimal = list(map(str, range(len(tokens))))
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, made = zip(*merges)
        self._table("merges", pair=[x << 20 | y for x, y in zip(left, right)], id=made, safe=[k not in unsafe for k in made])
        self._table("vocab", id=list(ids.values()), shown=[t.decode("latin-1") for t in ids])
        self.young = [{}, {}]  # ids of words in the last two generations, the younger first

    def _table(self, name: str, **columns) -> None:
        rows = self.pa.table({k: self.pa.array(v) for k, v in columns.items()})  # noqa: F841  read by name
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM rows")

    def _known(self, wanted: set) -> dict[str, bytes]:
        """A mapping that has all ``wanted`` words; new ones are made in batches of about ``ROWS`` rows. It is good until the
        next call."""
        if len(self.young[0]) > KEPT:
            self.young = [{}, self.young[0]]
        young, old = self.young
        missing = wanted.difference(young)
        young.update((k, old[k]) for k in missing.intersection(old))
        new = sorted(missing.difference(old))
        for part in _parts(new, ROWS):
            young.update(self._contract(part))
        self.long = [k for k in new if len(k) > WINDOW]
        return young

    def _forget(self) -> None:
        """Long words are rare and would fill the memo."""
        for k in self.long:
            self.young[0].pop(k, None)

    def _contract(self, words: list[str]) -> dict[str, bytes]:
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        short = self._fixpoint([x for x in raw.values() if len(x) <= WINDOW])
        out = {w: short[x] for w, x in raw.items() if len(x) <= WINDOW}
        return out | {w: self._joined(x).astype("<u4").tobytes() for w, x in raw.items() if len(x) > WINDOW}

    def _fixpoint(self, raw: list[bytes]) -> dict[bytes, bytes]:
        """Ids (as ``encode`` gives them) of each byte string by the recursive queries."""
        out: dict[bytes, bytes] = {}
        for query, shift, own in ((STEP, 20, [x for x in raw if len(x) <= WINDOW]), (LONG_STEP, 40, [x for x in raw if len(x) > WINDOW])):
            for part in _parts(own, ROWS):
                self._run(query, shift, part, out)
        return out

    def _run(self, query: str, shift: int, own: list[bytes], out: dict[bytes, bytes]) -> None:
        n = np.array([len(x) for x in own], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(own), np.uint8)]
        w = np.repeat(np.arange(len(own), dtype=np.int64), n)
        at = (w << shift) + np.arange(len(ids), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        while len(at):
            w = at >> shift
            ends = np.append(w[1:] != w[:-1], True)
            right = {"right_spot": np.where(ends, -1, np.append(at[1:], -1)), "right_id": np.where(ends, -1, np.append(ids[1:], -1))}
            self._table("seed", spot=at, w=w, id=ids, **right)
            depth = int(max(1, DEPTH * ROWS // len(at)))
            got = self.db.execute(query.replace("$depth", str(depth))).fetchnumpy()
            step, at, ids = (np.asarray(got[k]) for k in ("step", "spot", "id"))
            w = at >> shift
            last = np.zeros(len(own), step.dtype)
            np.maximum.at(last, w, step)
            final = step == last[w]  # a word's state after its last contraction
            order = np.argsort(at[final], kind="stable")
            at, ids, w = at[final][order], ids[final][order], w[final][order]
            open_ = last[w] == depth
            done_w, done_ids = w[~open_], ids[~open_]
            begins = np.flatnonzero(np.append(True, done_w[1:] != done_w[:-1])) if len(done_w) else done_w
            cuts, joined = [*(4 * begins).tolist(), 4 * len(done_w)], done_ids.astype("<u4").tobytes()
            out.update((own[k], joined[lo:hi]) for k, lo, hi in zip(done_w[begins].tolist(), cuts, cuts[1:]))
            at, ids = at[open_], ids[open_]

    def _joined(self, raw: bytes) -> np.ndarray:
        """Ids of a long word from those of overlapping windows, see the module's text."""
        width, known = WINDOW, {}
        spans = _windows(0, len(raw), width)
        while True:
            cut = [raw[lo:hi] for lo, hi in spans]
            known |= self._fixpoint(list(set(cut).difference(known)))
            out, apart, since = [], set(), 0  # ids so far; spans that don't meet the next one; where the last joint ends
            for k, (lo, _) in enumerate(spans):
                ids = np.frombuffer(known[cut[k]], "<u4")
                ends = lo + np.cumsum(self.size[ids])
                starts = ends - self.size[ids]
                upto = len(ids)
                if k + 1 < len(spans):
                    after = np.frombuffer(known[cut[k + 1]], "<u4")
                    ends_after = spans[k + 1][0] + np.cumsum(self.size[after])
                    _, here, there = np.intersect1d(ends, ends_after, assume_unique=True, return_indices=True)
                    same = (ids[here] == after[there]) & (starts[here] >= since)
                    if not same.any():
                        apart.add(k)
                        since = max(since, spans[k + 1][0])
                        continue
                    upto = int(here[np.argmax(same)]) + 1
                out.append(ids[int(np.searchsorted(starts, since)) : upto])
                since = int(ends[upto - 1])
            if not apart:
                return np.concatenate(out)
            width *= WIDER
            wider, k = [], 0
            while k < len(spans):
                first = k
                while k in apart:
                    k += 1
                wider += _windows(spans[first][0], spans[k][1], width) if k > first else [spans[k]]
                k += 1
            spans = wider

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) for t in texts]
        known = self._known(set().union(*cut))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        self._forget()
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        ids, shown = np.frombuffer(b"".join(encoded), "<u4"), []
        for lo in range(0, len(ids), ROWS):
            part = ids[lo : lo + ROWS].astype(np.int64)
            at = np.arange(len(part), dtype=np.int64)
            self._table("pieces", p=at // PIECE, pos=at, id=part)
            shown += [x for (x,) in self.db.execute(JOINED).fetchall()]
        data = "".join(shown).encode("latin-1")
        ends = [0, *accumulate(int(self.size[np.frombuffer(x, "<u4")].sum()) for x in encoded)]
        return [data[lo:hi] for lo, hi in zip(ends, ends[1:])]


_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def _slices(texts: list, most_chars: int = 1 << 21):
    lo, held = 0, 0
    for hi, t in enumerate(texts):
        if hi > lo and held + len(t) > most_chars:
            yield lo, hi
            lo, held = hi, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _slices(texts):
                ids = [array("I", x).tolist() for x in own.encode(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for lo, hi in _slices(ids):
                got = own.decode([array("I", x or []).tobytes() for x in ids[lo:hi]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(got, pa.binary())], names=["doc_id", "data"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes (data) that ``ids`` stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, data binary")


def _round_trip(path: str):
    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _slices(texts):
                ids = own.encode(texts[lo:hi])
                said = [hashlib.sha256(",".join(map(own.decimal.__getitem__, array("I", x))).encode()).hexdigest() for x in ids]
                data = [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), n, pa.array(said, pa.string()), pa.array(data, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode, then decode of the ids, with digests of both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
