"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``; where nothing is set, a local session uses a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


class Scratch:
    """Tables of one evaluation. They go when the driver ends: results may be lazy reads of them until then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/rules-{uuid.uuid4().hex[:12]}"
        self.used = False

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            self.drop(self.folder)

    def store(self, df: DataFrame) -> tuple[DataFrame, str]:
        if not self.used:
            self.used = True
            atexit.register(self._forget)
        path = f"{self.folder}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.store(df)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
