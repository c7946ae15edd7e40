"""Shared pieces: scratch tables in the shared folder, ordered buckets, bounded memo tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIN = -(2**63)
PART_BYTES = 32 << 20  # of input, for one ordered bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder: what the session names in ``spark.checkpoint.dir``; a temporary one for local sessions (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def remove():
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stored``, dealt by ``key``: joins on it do not shuffle these rows again."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(known)
    return spark.table(known)


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def order_key(col: str = "doc_id") -> Column:
    """An id as a long that sorts nulls first."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_MIN))


def id_bounds(df: DataFrame, key: Column, buckets: int, per_bucket: int = 60) -> list[int]:
    """Ascending values of ``key``, all of them present in ``df``, that start its 2nd, 3rd ... bucket.

    A sample of ``per_bucket`` ids for each bucket is collected; its size follows the number of
    buckets (at most), not that of the rows.
    """
    ids = df.select(key.alias("k"))
    n = ids.count()
    if not n:
        return []
    share = min(1.0, per_bucket * buckets / n)
    got = sorted({r.k for r in (ids if share == 1.0 else ids.sample(share, seed=7)).collect()})
    cuts = sorted({got[i * len(got) // buckets] for i in range(1, buckets)} if got else ())
    return cuts[1:] if cuts and cuts[0] == got[0] else cuts


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below ``key``: a two-level search in the JVM."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    text = lambda xs: "array(" + ", ".join(f"{x}L" if x > _MIN else f"cast('{x}' as bigint)" for x in xs) + ")"
    first = F.expr(text([g[0] for g in groups]))
    every = F.expr("array(" + ", ".join(text(g) for g in groups) + ")")
    coarse = F.size(F.filter(first, lambda b: b <= key))
    fine = F.size(F.filter(F.get(every, coarse - 1), lambda b: b <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine).cast("int")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files (or local rows) that a plan reads, as far as they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def ordered_buckets(df: DataFrame, key: Column) -> tuple[Column, int, list[int]]:
    """A column with each row's bucket in ascending order of ``key``, how many buckets there may be, and the bounds. Buckets
    are meant as partitions (``repartitionById``): at least the session's number, more where the input is large."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PART_BYTES))
    bounds = id_bounds(df, key, parts)
    return bucket_of(key, bounds), parts, bounds


def release() -> None:
    """This process's freed memory goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """The driver's freed memory goes back to the system, Python's and the JVM's: else what collected rows, compiled plans
    and buffers of one step took counts beside what the next one takes."""
    gc.collect()
    release()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()  # buffers outside the heap are freed with their owners
    with contextlib.suppress(Exception):  # only some JVMs have it
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # py4j can't see the class behind this interface
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def lean(run):
    """``run`` (for mapInArrow) that gives its memory back to the system when a partition ends: Spark keeps workers for later
    stages, and what allocators hold back would count beside theirs."""

    def freed(batches):
        yield from run(batches)
        release()

    return freed


class Memo(dict):
    """A mapping that makes what it lacks and holds at most two generations of ``limit`` entries."""

    def __init__(self, make, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
