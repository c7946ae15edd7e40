"""Rule sets without negation over a stream of triples.

Such rules only ever add. The first micro-batch is evaluated with the base; later ones are a delta: rules run over what is
new in them, joined with what came before, round by round (``RuleEngine.extend``), and only new conclusions are
written. The union of all batches is what one evaluation over everything would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..engine import RuleEngine
from ..graph import Graph
from ..plans.fixpoint import unknown
from ..plans.stratify import StratificationError, reads
from ..storage import Scratch


def apply_rules(engine: RuleEngine, stream: DataFrame, base: Graph, path: str) -> DataStreamWriter:
    """A writer (start it yourself) that keeps the stream's triples (s, p, o) and all that follows from them and
    ``base`` in the Parquet table ``path``, a folder for each batch: a batch that is run again replaces its own folder."""
    if any(reads(r.body)[1] for r in engine.rules):
        raise StratificationError("rules with negation can't run over a stream: a later triple may take back a conclusion")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark)
        graph, kept = base.copy(), _earlier(spark, path, number)
        if kept is not None:
            graph.add_frame(kept)
        new = scratch.keep(Graph(spark).add_frame(batch).triples())
        new = scratch.keep(unknown(new, graph.triples(False)))
        if kept is None:  # what follows from the base alone is still to be found
            graph.loose.append(new)
            found = engine.evaluate(graph, inplace=False, results_only=True).triples(False)
        else:
            found = engine.extend(graph, new)
        rows = found.unionByName(new).distinct()
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(run).outputMode("append")


def _earlier(spark, path: str, number: int) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).where(F.col("batch") < number).select("s", "p", "o")
