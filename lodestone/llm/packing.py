"""Best-fit packing with swap-based local search (operator 8).

1. Every text is encoded where it lies; pieces longer than a sequence are cut. Only numbers remain.
2. Piece rows are dealt at random into groups of about ``GROUP`` pieces and each group is packed in
   one task: best-fit over descending lengths, then local search. So tasks are many and memory is bounded.
3. What a group loses by standing alone is a part of its last bins. Pieces of the bins with room are pooled, dealt
   into (far fewer) groups and packed again, until one group holds them all or no bin was saved.

Local search: the emptiest bin is the donor. Its pieces leave by moves into bins that hold them, or by exchange: one for one
smaller piece, two for one, one for two, of a bin that is at least as full. Each step raises the sum of squared
fills; a donor that becomes empty is dropped. When no step helps the donor any more, the next emptiest is, until every bin
with room has been one since a bin was last saved, or the pieces' total shows that no bin can be saved. All pieces,
and all pairs of pieces of a bin, are candidates.

Defined results: a null text is empty (one piece, the end id); repeated rows are all packed; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table, whole_text

CAPACITY = 4096
END_ID = 1
GROUP = 5_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(path: str, kind: str, end_id: int, capacity: int, memos: tuple[int, ...] = ()):
    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc, end = encoder(path, kind, *memos), np.uint32(end_id).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode(text.as_py()) + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[lo : lo + 4 * capacity]
                    for column, x in zip(out, (doc, k, lo // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, memos: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length and checksum of each piece of at most ``capacity`` tokens. memos: limits of the encoder's,
    which bound a worker's memory."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(lean(_cut(vocabulary, kind, end_id, capacity, memos)), PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: in descending size, each goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    left: list[tuple[int, int]] = []  # ascending room, bin
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(left, (sizes[i], -1))
        if at < len(left):
            room, b = left.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > sizes[i]:
            insort(left, (room - sizes[i], b))
    return bins


class Search:
    """Bins of one group under local search; see the module's text."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.capacity, self.size = capacity, np.asarray(sizes, np.int64)
        fill = [sum(sizes[i] for i in b) for b in bins]
        self.full = [b for b, f in zip(bins, fill) if f == capacity]
        self.bins = [b[:] for b, f in zip(bins, fill) if f < capacity]
        self.room = np.array([capacity - f for f in fill if f < capacity], np.int64)
        self.items = np.array(sorted(i for b in self.bins for i in b), np.int64)
        self.own = self.size[self.items]
        self.place = np.full(len(sizes), -1, np.int64)
        for k, b in enumerate(self.bins):
            self.place[b] = k
        self.live = np.ones(len(self.bins), bool)
        self.sums: dict[int, tuple] = {}  # of each bin's pairs: ascending distinct sums and a pair of each
        self.flat: tuple | None = None
        self.fewest = -(-sum(sizes) // capacity)

    def run(self) -> list[list[int]]:
        tried = np.zeros(len(self.bins), bool)  # since a bin was emptied
        hopeless: set[tuple] = set()  # bins by their sizes, since the last step: equal ones can do no more
        while len(self.full) + int(self.live.sum()) > self.fewest and (self.live & ~tried).any():
            donor = int(np.argmax(np.where(self.live & ~tried, self.room, -1)))
            looks = tuple(sorted(self.size[self.bins[donor]].tolist()))
            if looks not in hopeless:
                while self.live[donor] and self.relieve(donor):
                    hopeless.clear()
                hopeless.add(tuple(sorted(self.size[self.bins[donor]].tolist())))
            tried[donor] = True
            if not self.live[donor]:
                tried[:] = False
        return self.full + [b for b, live in zip(self.bins, self.live) if live]

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.sums:
            b = np.array(self.bins[k], np.int64)
            x, y = np.triu_indices(len(b), 1)
            sums, first = np.unique(self.size[b[x]] + self.size[b[y]], return_index=True)
            self.sums[k] = (sums, b[x[first]], b[y[first]])
        return self.sums[k]

    def all_pairs(self) -> tuple[np.ndarray, ...]:
        """Of all bins: sums, pieces and the bin of each pair."""
        if self.flat is None:
            live = np.flatnonzero(self.live).tolist()
            parts = [self.pairs(k) for k in live]
            of = np.repeat(live, [len(p[0]) for p in parts]) if live else np.zeros(0, np.int64)
            self.flat = (*(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3)), of)
        return self.flat

    def relieve(self, donor: int) -> bool:
        """One step that moves weight out of ``donor`` into a bin at least as full."""
        mine = np.array(sorted(self.bins[donor], key=lambda i: -self.size[i]), np.int64)
        takes = self.live & (self.room <= self.room[donor])
        takes[donor] = False
        order = np.flatnonzero(takes)
        order = order[np.argsort(self.room[order], kind="stable")]
        if not len(order):
            return False
        at = np.searchsorted(self.room[order], self.size[mine])  # the fullest bin that holds each piece
        can = np.flatnonzero(at < len(order))
        if len(can):
            self.shift([mine[can[0]]], donor, int(order[at[can[0]]]))
            return True
        where = self.place[self.items]
        spare = np.where(takes[where], self.room[where], 0)
        sizes, first = np.unique(self.size[mine], return_index=True)
        pair_sums, px, py = self.pairs(donor)
        for out, left in ((sizes, (mine[first],)), (pair_sums, (px, py))):  # one for one, two for one
            if not len(out):
                continue
            best = np.searchsorted(out, self.own + spare, "right") - 1  # the most that fits in a piece's stead
            gain = np.where(best >= 0, out[np.maximum(best, 0)] - self.own, 0)
            can = np.flatnonzero((gain > 0) & (spare > 0))
            if len(can):
                j = can[np.argmin(spare[can] - gain[can])]
                to = int(where[j])
                self.shift([x[best[j]] for x in left], donor, to)
                self.shift([self.items[j]], to, donor)
                return True
        sums, qx, qy, of = self.all_pairs()  # one for two
        spare = np.where(takes[of], self.room[of], 0)
        best = np.searchsorted(sizes, sums + spare, "right") - 1
        gain = np.where(best >= 0, sizes[np.maximum(best, 0)] - sums, 0)
        can = np.flatnonzero((gain > 0) & (spare > 0))
        if len(can):
            j = can[np.argmin(spare[can] - gain[can])]
            to = int(of[j])
            self.shift([mine[first[best[j]]]], donor, to)
            self.shift([qx[j], qy[j]], to, donor)
            return True
        return False

    def shift(self, moved, a: int, b: int) -> None:
        for i in map(int, moved):
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.place[i] = b
            self.room[a] += self.size[i]
            self.room[b] -= self.size[i]
        self.flat = None
        self.sums.pop(a, None)
        self.sums.pop(b, None)
        self.live[a], self.live[b] = bool(self.bins[a]), True


def improve(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins after local search."""
    return Search(sizes, bins, capacity).run()


def _pack_group(capacity: int, level: int):
    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"]).reset_index(drop=True)
        sizes = pdf["length"].tolist()
        sequence, offset, room = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for k, b in enumerate(improve(sizes, best_fit(sizes, capacity), capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += sizes[i]
            room[b] = capacity - at
        pdf["sequence_id"] = (level << 56) + (int(pdf["g"].iloc[0]) << 24) + sequence
        pdf["offset"] = offset
        pdf["room"] = room
        return pdf.drop(columns="g")

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    done, level, bins = [], 0, None
    left = pieces.count()
    while True:
        groups = max(1, -(-left // group))
        key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level), F.monotonically_increasing_id())
        dealt = pieces.withColumn("g", F.pmod(key, F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_pack_group(capacity, level), PACKED + ", room long")
        if groups == 1:
            done.append(packed)
            break
        packed = stored(packed, "packed")
        now = packed.where("room > 0").agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("rows")).first()
        if bins is not None and now.bins >= bins or not now.rows:
            done.append(packed)
            break
        done.append(packed.where("room = 0"))
        pieces, left, bins, level = packed.where("room > 0").select(*pieces.columns), now.rows, now.bins, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("room")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(stored(pieces, "pieces"))
