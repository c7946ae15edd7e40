"""Token ids as Parquet list columns (operator 5).

Files: one folder for each bucket of ascending ids (``bucket=0``, ``bucket=1`` ...), rows in
ascending id order, columns ``doc_id, n_tokens, local_start, tokens``. Token lists are dictionary
encoded (a vocabulary's ids take at most two bytes each), ids, counts and starts are delta encoded
(Parquet's second writer version with the dictionary off), row groups and pages are bounded and
carry page indexes: a reader that asks for counts never touches tokens, and one that asks for a
range of ids reads its row groups and pages alone.

A row's position among all ids is its bucket's base, summed from the files' own metadata columns,
plus ``local_start``; no task ever needs the rows of another.

Defined results: a null text is empty (it still gets the end id); a null id sorts first; repeated ids
are all kept, ordered by text; an empty table gives empty files; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, order_key, ordered_buckets, table, whole_text

END_ID = 2
SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)
#: Bytes of a row group, rows of a page: small enough for selective reads, large enough to compress.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "256",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#local_start": "false",
}


def _encode(path: str, kind: str, end_id: int | None):
    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc, end = encoder(path, kind), b"" if end_id is None else np.uint32(end_id).tobytes()
        bucket, at = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [enc.encode(x) + end for x in part.column("text").to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = []
                for b, k in zip(part.column("bucket").to_pylist(), n.tolist()):
                    bucket, at = b, at if b == bucket else 0
                    starts.append(at)
                    at += k
                flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("bucket"), part.column("doc_id"), pa.array(n), pa.array(starts, pa.int64()), lists],
                    names=SCHEMA.names,
                )

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, kind: str = "byte") -> None:
    """Encodes every text and writes the files described above; the text is shuffled once, by id range."""
    key = order_key()
    bucket, parts, _ = ordered_buckets(docs, key)
    rows = docs.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(_encode(vocabulary, kind, end_id), SCHEMA).write.options(**LAYOUT).partitionBy("bucket").parquet(path)


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, tokens. Filters on doc_id reach row groups and pages."""
    files = spark.read.schema(SCHEMA).parquet(path)
    each = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    # one row for each bucket: as many as there are partitions, whatever the rows
    base = each.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    got = files.join(F.broadcast(base), "bucket")
    return got.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *["tokens"] * tokens)


def _checksums(batches):
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("tokens")
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def with_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of each token list."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_checksums(read_tokens(spark, path))
