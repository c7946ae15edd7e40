"""Files to graphs and back. Line formats are read and written by the executors, document formats by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..namespaces import Namespaces
from ..terms import BOOLEAN, INTEGERS, NUMERIC, TERM
from .documents import write_json_ld, write_xml
from .turtle import parse_json_ld, parse_turtle, parse_xml, write_turtle

#: File name endings (fixed values).
FORMATS = {
    "ttl": "turtle", "turtle": "turtle", "nt": "nt", "ntriples": "nt", "nq": "nquads", "nquads": "nquads", "n3": "turtle", "trig": "trig",
    "xml": "xml", "rdf": "xml", "owl": "xml", "jsonld": "json-ld", "json": "json-ld", "parquet": "parquet",
}
_NODE = r"(<[^>]*>|_:\S+)"
_OBJECT = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_NODE}\s+(<[^>]*>)\s+{_OBJECT}\s*{_NODE}?\s*\.\s*(?:#.*)?$"


def guess_format(path: str) -> str:
    return FORMATS.get(path.rstrip("/").rpartition(".")[2].lower(), "turtle")


def _unescaped(text):
    """Escapes of a quoted text; \\u sequences are decoded with the JSON reader, which writes them alike."""
    wide = F.regexp_replace(text, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    parsed = F.from_json(F.concat(F.lit('{"x":"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(wide, "\t", r"\\t"), r"\\'", "'"), r"[\r\n]", " "), F.lit('"}')), "x string").getField("x")
    return F.when(text.contains("\\"), parsed).otherwise(text)


def _term(token):
    """A token of a line as a general term."""
    iri, blank = token.startswith("<"), token.startswith("_:")
    dt = F.regexp_extract(token, r'"\^\^<([^>]*)>$', 1)
    raw = _unescaped(F.regexp_extract(token, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    ints, reals = raw.try_cast("decimal(38,0)").cast("string"), raw.try_cast("double").cast("string")
    value = (
        F.when(dt.isin(*INTEGERS) & raw.rlike(r"^[+-]?\d+$"), F.coalesce(ints, raw))
        .when(dt.isin(*INTEGERS), raw)
        .when(dt.isin(*NUMERIC), F.coalesce(reals, raw))
        .when(dt == BOOLEAN, F.when(raw == "1", "true").when(raw == "0", "false").otherwise(F.lower(raw)))
        .otherwise(raw)
    )
    return F.struct(
        F.when(iri, 1).when(blank, 2).otherwise(3).alias("k"),
        F.when(iri, F.substring(token, 2, 1 << 30)).when(blank, F.substring(token, 3, 1 << 30)).otherwise(value).alias("v"),
        F.when(iri | blank, "").otherwise(dt).alias("dt"),
        F.when(iri | blank, "").otherwise(F.lower(F.regexp_extract(token, r'"@([A-Za-z0-9-]+)$', 1))).alias("lang"),
    ).cast(TERM)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads (graph names are left out) as general triples; lines that are neither raise."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    checked = F.when(part(1) == "", F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))).otherwise(part(1))
    cut = lambda c: F.when(c.startswith("<"), F.substring(c, 1, F.length(c) - 1)).otherwise(c)
    return lines.select(_term(cut(checked)).alias("s"), _term(cut(part(2))).alias("p"), _term(cut(part(3))).alias("o"))


def read_graph(spark: SparkSession, path: str, format: str | None = None) -> Graph:
    """nt and nquads: one lazy distributed frame. parquet: a frame (s, p, o) of general terms. Others: parsed here."""
    format = format or guess_format(path)
    graph = Graph(spark)
    if format in ("nt", "nquads"):
        return graph.add_frame(read_lines(spark, path))
    if format == "parquet":
        return graph.add_frame(spark.read.parquet(path))
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    if format not in READERS:
        raise ValueError(f"unknown format {format!r}")
    return graph.add_triples(READERS[format](text))


READERS = {"turtle": parse_turtle, "n3": parse_turtle, "trig": lambda t: parse_turtle(t, True), "xml": parse_xml, "json-ld": parse_json_ld}


def _line_term(c: str):
    t = F.col(c)
    v = t.getField("v")
    body = v
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    tail = F.when(t.getField("lang") != "", F.concat(F.lit("@"), t.getField("lang"))).when(t.getField("dt") != "", F.concat(F.lit("^^<"), t.getField("dt"), F.lit(">"))).otherwise("")
    return (
        F.when(t.getField("k") == 1, F.concat(F.lit("<"), v, F.lit(">")))
        .when(t.getField("k") == 2, F.concat(F.lit("_:"), v))
        .when(t.getField("k") == 4, F.concat(F.lit("<<( "), v, F.lit(" )>>")))
        .otherwise(F.concat(F.lit('"'), body, F.lit('"'), tail))
    )


def triple_lines(graph: Graph) -> DataFrame:
    return graph.triples().select(F.concat_ws(" ", *map(_line_term, "spo"), F.lit(".")).alias("value"))


#: Document formats, written by the driver.
WRITERS = {"turtle": write_turtle, "n3": write_turtle, "trig": write_turtle, "xml": lambda rows, _: write_xml(rows), "json-ld": lambda rows, _: write_json_ld(rows)}


def write_graph(graph: Graph, path: str, format: str | None = None, namespaces: Namespaces | None = None) -> None:
    """nt and parquet: a folder that the executors write. Documents: one file, for graphs that the driver can hold."""
    format = format or guess_format(path)
    if format in ("nt", "nquads"):
        triple_lines(graph).write.mode("overwrite").text(path)
    elif format == "parquet":
        graph.triples().write.mode("overwrite").parquet(path)
    elif format in WRITERS:
        with open(path, "w", encoding="utf-8") as f:
            f.write(WRITERS[format](graph.triples().collect(), namespaces))
    else:
        raise ValueError(f"can't write {format!r}")
