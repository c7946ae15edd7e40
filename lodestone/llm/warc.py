"""WARC archives, written and read back with boundary-chain verification (operator 4).

Writing: one record for each row, uncompressed, through Spark's own text writer (so any store, and commits that
survive lost tasks). Rows with equal payloads (SHA-1 and length) keep one response, that of the largest id; the
others are revisits that refer to it. Only payload groups of two or more are joined back; payloads aren't shuffled
while that table is small enough to be broadcast.

Reading: archives are split anywhere. Every chunk that follows the magic ``WARC/1.1`` is a candidate; a task
computes its offset and, from its header's length, its successor's. Inside a block of the file pointers are
jumped to where the chain leaves the block; between blocks pointer jumping from offset 0 doubles the reached part
of the chain each round; then each block marks what its reached entry leads to. A magic inside a payload is a
candidate that nothing reachable points to, so it is dropped, and the chunks a payload was cut into are put
together again. All of this moves offsets only; payload columns are derived where the chunk lies.

Defined results: a null payload is empty; a null url has no target header; equal rows of the largest id are all
responses; null ids lose against any other (a group of null ids alone is all responses); an empty table writes an
empty archive, which has no records.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, table

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HOT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits become four base32 digits."""
    hexed = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("null")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest, and for revisits refers_to (else null)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    groups = rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 AND largest IS NOT NULL"), "equal-payloads")
    often = F.col("n") * HOT > (groups.agg(F.sum("n").alias("n")).first().n or 0)
    # fewer than HOT groups can hold a HOT-th of the rows each: they go to the rows, whose payloads stay where they are
    hot = groups.where(often).select("digest", "bytes", F.col("largest").alias("common"))
    rows = rows.join(F.broadcast(hot), ["digest", "bytes"], "left")
    apart = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # what is found already meets nothing, anywhere
    rows = rows.withColumn("key", F.when(F.col("common").isNull(), F.col("digest")).otherwise(apart))
    rest = groups.where(~often).select(F.col("digest").alias("key"), "bytes", "largest")
    joined = rows.join(rest, ["key", "bytes"], "left")  # Spark broadcasts the table if its stored size allows it
    joined = joined.withColumn("largest", F.coalesce("common", "largest"))
    refers = F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def records(rows: DataFrame) -> DataFrame:
    """One string column: each record without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    known = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise("WARC-Type: response\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        known("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        known("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Bytes", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    records(with_responses(pages)).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))


def header(name: str, head: str | Column = "head") -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _next(pdf):
    offsets, successor = pdf["offset"].to_numpy(), pdf["successor"].to_numpy()
    n = len(offsets)
    at = np.minimum(np.searchsorted(offsets, successor), n - 1)
    return offsets, successor, np.where(offsets[at] == successor, at, np.arange(n))


def _leave(pdf):
    """Where the chain from each candidate leaves its block."""
    import pandas as pd

    pdf = pdf.sort_values("offset")
    offsets, successor, jump = _next(pdf)
    while not np.array_equal(jump, jump[jump]):
        jump = jump[jump]
    return pd.DataFrame({"file": pdf["file"].to_numpy(), "block": pdf["block"].to_numpy(), "k": pdf["k"].to_numpy(), "offset": offsets, "successor": successor, "leaves": successor[jump]})


def _mark(pdf):
    """What the block's reached entry leads to, and for every chunk the reached record before it (-1: none in the block)."""
    import pandas as pd

    pdf = pdf.sort_values("offset")
    offsets, _, jump = _next(pdf)
    reached = pdf["entry"].to_numpy().astype(bool).copy()
    span = 1
    while span <= len(offsets):
        reached[jump[reached]] = True
        jump, span = jump[jump], 2 * span
    owner = np.maximum.accumulate(np.where(reached, offsets, -1))
    return pd.DataFrame({"file": pdf["file"].to_numpy(), "block": pdf["block"].to_numpy(), "k": pdf["k"].to_numpy(), "offset": offsets, "reached": reached, "owner": owner})


def _reached(placed: DataFrame) -> DataFrame:
    """(file, offset) of the candidates by which the chain from each file's start enters a block."""
    targets = placed.select("file", F.col("leaves").alias("offset")).distinct()
    start = placed.where("offset = 0").select("file", "offset")
    jumps = stored(placed.join(targets.unionByName(start).distinct(), ["file", "offset"]).select("file", "offset", F.col("leaves").alias("to")), "jumps")
    known = jumps.select("file", "offset")
    found, n = stored(start, "reached"), -1
    while (now := found.count()) != n:
        n = now
        to = found.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        to = to.join(known, ["file", "offset"], "left_semi")
        further = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        found, jumps = (
            stored(found.unionByName(to).distinct(), "reached"),
            stored(jumps.join(further, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")), "jumps"),
        )
    return found


def _payload(block: Column) -> Column:
    """A block's bytes after its HTTP header."""
    http = F.substring_index(block.cast("string"), END, 1)
    return F.substring(block, F.octet_length(http) + 5, F.octet_length(block))


Derive = dict[str, Callable[[Column], Column]]
WHOLE: Derive = {"payload": lambda p: p}


def read_archives(spark: SparkSession, path: str, derive: Derive = WHOLE) -> DataFrame:
    """file, offset, head (header lines) and the columns that ``derive`` makes of the payload's bytes."""
    cut = lambda x, a, n: F.expr(f"substring({x}, {a}, {n})")
    chunk = _chunks(spark, path).select(
        "*", F.octet_length("value").cast("long").alias("size"), F.substring_index("value", END, 1).alias("head"), F.col("value").cast("binary").alias("raw")
    )
    chunk = chunk.select("*", F.octet_length("head").cast("long").alias("head_size"), F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\t]*([0-9]+)', 1) AS bigint)").alias("length"))
    ok = (F.col("head_size") < F.col("size")) & F.col("length").isNotNull()
    whole = F.coalesce(ok & (F.col("head_size") + 4 + F.col("length") <= F.col("size")), F.lit(False))
    own = _payload(cut("raw", "cast(head_size + 5 AS int)", "cast(length AS int)"))
    narrow = stored(
        chunk.select("file", "block", "k", "size", F.when(ok, F.col("head_size") + F.col("length") + 8).alias("span"), "head", whole.alias("whole"), *[F.when(whole, f(own)).alias(c) for c, f in derive.items()]),
        "candidates",
    )
    # offsets: sums over earlier blocks of the file, then over earlier chunks of the block
    sums = narrow.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    inside = F.sum(F.col("size") + len(MAGIC)).over(Window.partitionBy("file", "block").orderBy("k")) - F.col("size") - len(MAGIC)
    spots = narrow.select("file", "block", "k", inside.alias("inside"), "span").join(sums.select("file", "block", before.alias("before")), ["file", "block"])
    offset = F.col("before") + F.col("inside") - len(MAGIC)
    spots = spots.select("file", "block", "k", offset.alias("offset"), F.coalesce(offset + len(MAGIC) + F.col("span"), F.lit(-1)).alias("successor"))
    shape = "file string, block long, k long, offset long"
    placed = stored(spots.groupBy("file", "block").applyInPandas(_leave, shape + ", successor long, leaves long"), "placed")
    entries = _reached(placed).withColumn("entry", F.lit(True))
    marked = placed.join(entries, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    marked = stored(marked.groupBy("file", "block").applyInPandas(_mark, shape + ", reached boolean, owner long"), "marked")
    real = marked.where("reached").select("file", "k", "offset").join(narrow, ["file", "k"])
    done = real.where("whole").select("file", "offset", "head", *derive)
    cut_up = stored(real.where("NOT whole").select("file", "offset", "head"), "cut-up")
    if not cut_up.count():
        return done
    # a record whose payload holds the magic: its chunks come together again, a group for each record
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    owned = marked.join(last.select("file", "block", carried.alias("carried")), ["file", "block"])
    owned = owned.select("file", "k", F.col("offset").alias("chunk_offset"), F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")).alias("offset"))
    owned = owned.join(cut_up.select("file", "offset"), ["file", "offset"])
    parts = _chunks(spark, path).select("file", "k", "value").join(owned, ["file", "k"])
    joined = parts.groupBy("file", "offset").agg(F.concat_ws(MAGIC, F.transform(F.sort_array(F.collect_list(F.struct("chunk_offset", "value"))), lambda x: x.value)).cast("binary").alias("raw"))
    joined = joined.join(cut_up, ["file", "offset"]).withColumns({"head_size": F.octet_length("head"), "length": header("Content-Length").cast("int")})
    own = _payload(cut("raw", "head_size + 5", "length"))
    return done.unionByName(joined.select("file", "offset", "head", *[f(own).alias(c) for c, f in derive.items()]))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, {"own_bytes": lambda p: F.octet_length(p).cast("long"), "own_digest": base32_sha1})
    revisit = F.col("record_type") == "revisit"
    found = found.select("*", header("WARC-Type").alias("record_type"))
    # a revisit has no payload of its own: both come from its record, which was written from the full payload
    return found.select(
        header("X-Page-Id").cast("long").alias("page_id"),
        F.when(revisit, header("X-Payload-Bytes").cast("long")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring(header("WARC-Payload-Digest"), 6, 32)).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type",
        header("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


#: DuckDB's version of op4_warc's rows.
OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p
"""
