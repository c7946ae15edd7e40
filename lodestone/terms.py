"""RDF terms as Spark columns.

Two encodings. A *typed* cell has a type known when planning (kind, datatype, language, perhaps an IRI template) and
one native column, so table data stays in its own Spark type through scans, joins and arithmetic. A *general* cell is a
struct ``<k, v, dt, lang>`` (k: 1 IRI, 2 blank, 3 literal, 4 triple term) whose fields are never null inside a struct that
isn't. A null cell stands for an expression error.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import IRI, XSD, Blank, Literal, TripleTerm

TERM = "struct<k:int,v:string,dt:string,lang:string>"
URI, BNODE, LITERAL, TRIPLE = 1, 2, 3, 4
#: Datatypes whose values are compared as numbers (fixed values).
INTEGERS = tuple(
    XSD + n
    for n in (
        "integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt",
        "unsignedShort", "unsignedByte", "nonPositiveInteger", "negativeInteger",
    )
)
INTEGER, DECIMAL, DOUBLE, FLOAT = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "float"
BOOLEAN, STRING, DATETIME = XSD + "boolean", XSD + "string", XSD + "dateTime"
NUMERIC = (*INTEGERS, DECIMAL, DOUBLE, FLOAT)


class Type(NamedTuple):
    """What is known of a typed cell's terms. native: the Spark type of its column; template: an IRI's text before the key."""

    kind: int
    dt: str = ""
    lang: str = ""
    template: str = ""
    native: str = "string"


PLAIN = Type(LITERAL)
TRUTH = Type(LITERAL, BOOLEAN, native="boolean")
BIG = Type(LITERAL, INTEGER, native="bigint")
HUGE = Type(LITERAL, INTEGER, native="decimal(38,0)")
REAL = Type(LITERAL, DOUBLE, native="double")
PLAIN_IRI = Type(URI)


class Cell:
    """One value of every row: a typed column, or a general one (``type`` None)."""

    __slots__ = ("type", "col")

    def __init__(self, type: Type | None, col: Column):
        self.type, self.col = type, col

    def part(self, name: str) -> Column:
        """k, v, dt or lang; null where the cell is."""
        if self.type is None:
            return self.col.getField(name)
        t = self.type
        if name == "v":
            if t.native.startswith("timestamp"):
                text = F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss")
            elif t.native == "double":
                text = (self.col + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one number
            else:
                text = self.col if t.native == "string" else self.col.cast("string")
            return F.concat(F.lit(t.template), text) if t.template else text
        value = {"k": t.kind, "dt": t.dt, "lang": t.lang}[name]
        return F.when(self.col.isNotNull(), F.lit(value))

    @property
    def v(self) -> Column:
        return self.part("v")

    def struct(self) -> Column:
        if self.type is None:
            return self.col
        t = self.type
        made = F.struct(F.lit(t.kind).alias("k"), self.v.alias("v"), F.lit(t.dt).alias("dt"), F.lit(t.lang).alias("lang"))
        return F.when(self.col.isNotNull(), made).cast(TERM)

    def is_null(self) -> Column:
        return self.col.isNull()


def general(k, v: Column, dt="", lang="") -> Cell:
    """A general cell from its parts; null where ``v`` is."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(as_col(k).cast("int").alias("k"), v.alias("v"), as_col(dt).alias("dt"), as_col(lang).alias("lang"))
    return Cell(None, F.when(v.isNotNull(), made).cast(TERM))


def plain(v: Column) -> Cell:
    return Cell(PLAIN, v)


def truth(b: Column) -> Cell:
    return Cell(TRUTH, b)



def error() -> Cell:
    return Cell(PLAIN, F.lit(None).cast("string"))


def canonical(value: str, dt: str) -> str:
    """Equal numbers and booleans get equal text; ill-formed text stays."""
    try:
        if dt in INTEGERS:
            return str(int(value))
        if dt in (DECIMAL, DOUBLE, FLOAT):
            return double_text(float(value))
    except ValueError:
        return value
    if dt == BOOLEAN:
        return {"1": "true", "0": "false"}.get(value, value.lower() if value.lower() in ("true", "false") else value)
    return value


def double_text(x: float) -> str:
    """A double as Spark prints it."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}[repr(x)]
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        text = repr(x)
        return text if "e" not in text and "." in text else f"{x:.17g}"
    mantissa, exponent = f"{x:.17e}".split("e")
    for digits in range(1, 18):
        short = f"{x:.{digits}e}"
        if float(short) == x:
            mantissa, exponent = short.split("e")
            break
    mantissa = mantissa.rstrip("0")
    return f"{mantissa + '0' if mantissa.endswith('.') else mantissa}E{int(exponent)}"


def triple_text(t: TripleTerm) -> str:
    return " ".join(term_text(x) for x in (t.subject, t.predicate, t.object))


def term_text(x) -> str:
    """A ground term in N-Triples syntax."""
    if isinstance(x, IRI):
        return f"<{x.value}>"
    if isinstance(x, Blank):
        return f"_:{x.label}"
    if isinstance(x, TripleTerm):
        return f"<<( {triple_text(x)} )>>"
    text = canonical(x.value, x.datatype).translate({0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"})
    tail = f"@{x.language}" if x.language else f"^^<{x.datatype}>" if x.datatype else ""
    return f'"{text}"{tail}'


def row_of(x) -> tuple[int, str, str, str]:
    """A ground term as the fields of the struct."""
    match x:
        case IRI(value):
            return URI, value, "", ""
        case Blank(label):
            return BNODE, label, "", ""
        case TripleTerm():
            return TRIPLE, triple_text(x), "", ""
        case Literal(value, dt, lang):
            return LITERAL, canonical(value, dt), dt, lang.lower()
    raise TypeError(f"not a ground term: {x!r}")


def constant(x) -> Cell:
    """A ground term as a cell."""
    k, v, dt, lang = row_of(x)
    if dt == INTEGER and v.lstrip("-").isdigit() and abs(int(v)) < 2**63:
        return Cell(BIG, F.lit(int(v)).cast("bigint"))
    if dt == BOOLEAN and v in ("true", "false"):
        return Cell(TRUTH, F.lit(v == "true"))
    if dt in (DOUBLE, DECIMAL):
        try:
            return Cell(Type(LITERAL, dt, native="double"), F.lit(float(v)))
        except ValueError:
            pass
    return Cell(Type(k, dt, lang), F.lit(v))


def unified(types: list[Type | None]) -> Type | None:
    """The common type, or None if columns of these types must become general."""
    return types[0] if types and all(t == types[0] for t in types) else None


def as_type(cell: Cell, t: Type | None) -> Column:
    return cell.col if t is not None and cell.type == t else cell.struct()


def equal_terms(a: Cell, b: Cell) -> Column:
    """The same RDF term (not: the same value)."""
    if a.type is not None and b.type is not None:
        if a.type == b.type:
            return a.col == b.col
        if (a.type.kind, a.type.dt, a.type.lang) != (b.type.kind, b.type.dt, b.type.lang):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        return a.v == b.v
    return a.struct() == b.struct()
