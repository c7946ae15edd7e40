"""A graph as a catalogue of relations, one for each predicate.

A relation is a list of fragments: a lazy frame with expressions for subject and object and, where known, their
types. Table columns are fragments of their table, so a pattern reads the columns it names and nothing else, and
patterns that share a subject are read from one scan. Triples whose predicate is only known from data (large
files) stay in one frame and are filtered when a predicate is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import RDF_TYPE
from .terms import BOOLEAN, DATETIME, DOUBLE, INTEGER, LITERAL, TERM, URI, Cell, Type, as_type, row_of, unified

_WHOLE = ("int", "bigint", "smallint", "tinyint")
_NATIVE = {
    "int": ("bigint", INTEGER), "bigint": ("bigint", INTEGER), "smallint": ("bigint", INTEGER), "tinyint": ("bigint", INTEGER),
    "double": ("double", DOUBLE), "float": ("double", DOUBLE), "boolean": ("boolean", BOOLEAN), "timestamp": ("timestamp", DATETIME), "timestamp_ntz": ("timestamp_ntz", DATETIME),
    "string": ("string", ""),
}


@dataclass
class Fragment:
    df: DataFrame
    s: Column
    o: Column
    s_type: Type | None
    o_type: Type | None
    source: object = None  # fragments of one source have one row for each subject
    constant: str | None = None  # an IRI that is every row's object
    unique: bool = False  # no pair of subject and object occurs twice

    def pairs(self) -> DataFrame:
        got = self.df.select(self.s.alias("s"), self.o.alias("o"))
        return got.where("s IS NOT NULL AND o IS NOT NULL")


def empty(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit(None).cast(TERM).alias("s"), F.lit(None).cast(TERM).alias("p"), F.lit(None).cast(TERM).alias("o"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def predicate_struct(iri: str) -> Column:
    return F.struct(F.lit(URI).alias("k"), F.lit(iri).alias("v"), F.lit("").alias("dt"), F.lit("").alias("lang")).cast(TERM)


@dataclass
class Table:
    """How a table's rows become triples. key: columns of the subject (a digest of all columns if empty); unique: no two
    rows have the same key; links: column -> class of the rows its values name. Rows with a null in the key have
    no subject and so no triples; rows of equal content have one subject where there is no key."""

    df: DataFrame
    name: str
    key: tuple[str, ...] = ()
    links: dict[str, str] = field(default_factory=dict)
    namespace: str = "http://example.org/"
    skip: tuple[str, ...] = ()
    unique: bool = False


def _escaped(c: str, kind: str) -> Column:
    """A part of a key as text without the sign that separates parts."""
    text = F.col(c).cast("string")
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")) if kind not in _WHOLE else text


def row_digest(columns: list[str]) -> Column:
    """Of all columns, nulls and the lengths of the others' texts included."""
    texts = [F.col(c).cast("string") for c in columns]
    parts = [F.when(t.isNotNull(), F.concat(F.length(t).cast("string"), F.lit(":"), t)).otherwise(F.lit("-")) for t in texts]
    return F.coalesce(F.sha2(F.concat_ws(",", *parts), 256), F.lit(""))  # never null, so tests for null fall away


class Graph:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.fragments: dict[str, list[Fragment]] = {}
        self.loose: list[DataFrame] = []  # (s, p, o) of general terms

    def copy(self) -> Graph:
        g = Graph(self.spark)
        g.fragments = {p: list(fs) for p, fs in self.fragments.items()}
        g.loose = list(self.loose)
        return g

    # building

    def add(self, predicate: str, fragment: Fragment) -> Graph:
        self.fragments.setdefault(predicate, []).append(fragment)
        return self

    def add_pairs(self, predicate: str, df: DataFrame, s_type: Type | None, o_type: Type | None) -> Graph:
        """``df`` has columns s and o."""
        return self.add(predicate, Fragment(df, F.col("s"), F.col("o"), s_type, o_type))

    def add_frame(self, df: DataFrame) -> Graph:
        """General triples (s, p, o)."""
        self.loose.append(df.select(*[F.col(c).cast(TERM).alias(c) for c in "spo"]))
        return self

    def add_triples(self, triples) -> Graph:
        """Ground triples known to the driver."""
        by: dict[str, list] = {}
        for t in triples:
            by.setdefault(t.predicate.value, []).append((row_of(t.subject), row_of(t.object)))
        for p, rows in by.items():
            self.add_pairs(p, self.spark.createDataFrame(sorted(set(rows)), f"s {TERM}, o {TERM}"), None, None)
        return self

    def add_table(self, table: Table) -> Graph:
        """Every column of a table as a predicate, and rdf:type. Nothing is read until a rule asks for it."""
        df, ns = table.df, table.namespace
        kinds = dict(df.dtypes)
        if len(table.key) == 1:
            key = F.col(table.key[0]).cast(_NATIVE.get(kinds[table.key[0]], ("string", ""))[0])
            native = _NATIVE.get(kinds[table.key[0]], ("string", ""))[0]
        elif table.key:
            parts = [_escaped(c, kinds[c]) for c in table.key]
            key, native = F.concat(*[x for p in parts for x in (F.lit("/"), p)][1:]), "string"
        else:
            key, native = row_digest(df.columns), "string"
        subject = Type(URI, template=f"{ns}{table.name}/", native=native)
        source = object() if table.unique or not table.key else None
        self.add(RDF_TYPE, Fragment(df, key, F.lit(f"{ns}{table.name.capitalize()}"), subject, Type(URI), source, f"{ns}{table.name.capitalize()}", table.unique))
        for c, kind in df.dtypes:
            if c in table.skip or kind not in _NATIVE:
                continue
            native, dt = _NATIVE[kind]
            value = F.col(c).cast(native)
            if c in table.links:
                o_type = Type(URI, template=f"{ns}{table.links[c]}/", native=native)
            else:
                o_type = Type(LITERAL, dt, native=native)
            self.add(f"{ns}{c}", Fragment(df, key, value, subject, o_type, source, unique=table.unique))
        return self

    # reading

    def scan(self, predicate: str) -> list[Fragment]:
        found = list(self.fragments.get(predicate, ()))
        for df in self.loose:
            own = df.where((F.col("p.v") == predicate) & (F.col("p.k") == URI))
            found.append(Fragment(own, F.col("s"), F.col("o"), None, None))
        return found

    def pairs(self, predicate: str) -> tuple[DataFrame, Type | None, Type | None]:
        """All (s, o) of a predicate with a common type."""
        return merged(self.spark, self.scan(predicate))

    def triples(self, distinct: bool = True) -> DataFrame:
        """Everything as general (s, p, o)."""
        frames = list(self.loose)
        for p, fs in self.fragments.items():
            for f in fs:
                got = f.pairs()
                frames.append(got.select(Cell(f.s_type, F.col("s")).struct().alias("s"), predicate_struct(p).alias("p"), Cell(f.o_type, F.col("o")).struct().alias("o")))
        whole = union_all(frames) if frames else empty(self.spark)
        return whole.distinct() if distinct else whole

    def predicates(self) -> set[str]:
        """Predicates known without reading data."""
        return set(self.fragments)

    def nodes(self) -> DataFrame:
        """Every subject and object (column n, general)."""
        t = self.triples(False)
        return t.select(F.col("s").alias("n")).unionByName(t.select(F.col("o").alias("n"))).distinct()

    def count(self) -> int:
        return self.triples().count()

    # set algebra on whole graphs

    def union(self, other: Graph) -> Graph:
        g = self.copy()
        for p, fs in other.fragments.items():
            g.fragments.setdefault(p, []).extend(fs)
        g.loose += other.loose
        return g

    def minus(self, other: Graph) -> Graph:
        mine, theirs = self.triples(), other.triples()
        return Graph(self.spark).add_frame(mine.join(theirs, ["s", "p", "o"], "left_anti"))

    def contains(self, triple) -> bool:
        s, p, o = map(row_of, (triple.subject, triple.predicate, triple.object))
        same = lambda c, r: (F.col(f"{c}.k") == r[0]) & (F.col(f"{c}.v") == r[1]) & (F.col(f"{c}.dt") == r[2]) & (F.col(f"{c}.lang") == r[3])
        return bool(self.triples(False).where(same("s", s) & same("p", p) & same("o", o)).limit(1).count())


def merged(spark: SparkSession, fragments: list[Fragment]) -> tuple[DataFrame, Type | None, Type | None]:
    """(s, o) of several fragments under common types."""
    if not fragments:
        return empty(spark).select("s", "o"), None, None
    s, o = unified([f.s_type for f in fragments]), unified([f.o_type for f in fragments])
    frames = [f.pairs().select(as_type(Cell(f.s_type, F.col("s")), s).alias("s"), as_type(Cell(f.o_type, F.col("o")), o).alias("o")) for f in fragments]
    return union_all(frames), s, o
