"""Built-in functions: name -> (cells, context) -> cell, all of them JVM-side expressions.

A null argument makes the result null unless a function says otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LANG_STRING, XSD
from ..terms import (
    BNODE, BOOLEAN, DATETIME, HUGE, INTEGERS, LITERAL, NUMERIC, PLAIN_IRI, REAL, STRING, TRIPLE, URI, Cell, Type,
    as_type, equal_terms, general, plain, truth, unified,
)
from .values import boolean, is_numeric, number, whole


@dataclass
class Context:
    """What a function may know beside its arguments."""

    now: str = "1970-01-01T00:00:00+00:00"
    rule: str = ""
    row: list[Column] = field(default_factory=list)  # text of the bound variables
    site: int = 0
    pattern_checked: bool = False  # the regular expression at hand is a constant that compiles

    def seed(self) -> Column:
        """A text that differs for each rule, call site and row, and never between evaluations."""
        self.site += 1
        return F.concat_ws("\x1f", F.lit(self.rule), F.lit(str(self.site)), *self.row)


def _flag(cell: Cell, known, column) -> Cell:
    """A test that is false, not an error, for null."""
    if cell.type is not None:
        return truth(F.when(cell.is_null(), False).otherwise(F.lit(bool(known(cell.type)))))
    return truth(F.coalesce(column(cell), F.lit(False)))


def _kind(k: int):
    return lambda a, c: _flag(a[0], lambda t: t.kind == k, lambda x: x.part("k") == k)


def _text(f):
    """A function of texts that gives a plain literal."""
    return lambda a, c: plain(f(*[x.v for x in a]))


def _test(f):
    return lambda a, c: truth(f(*[x.v for x in a]))


def _language(cell: Cell) -> Column:
    """The tag without a base direction."""
    return F.substring_index(cell.part("lang"), "--", 1)


def _direction(cell: Cell) -> Column:
    lang = cell.part("lang")
    return F.when(lang.contains("--"), F.substring_index(lang, "--", -1)).otherwise(F.when(lang.isNotNull(), ""))


def _langmatches(a, c):
    tag, want = F.lower(a[0].v), F.lower(a[1].v)
    return truth(F.when(want == "*", F.length(tag) > 0).otherwise(tag.startswith(want)))


def _datatype(a, c):
    t = a[0].type
    if t is not None:
        if t.kind != LITERAL:
            return Cell(PLAIN_IRI, F.lit(None).cast("string"))
        return Cell(PLAIN_IRI, F.when(~a[0].is_null(), t.dt or (LANG_STRING if t.lang else STRING)))
    dt = a[0].part("dt")
    return Cell(PLAIN_IRI, F.when(a[0].part("k") == LITERAL, F.when(dt != "", dt).when(a[0].part("lang") != "", LANG_STRING).otherwise(STRING)))


def _iri(a, c):
    return Cell(PLAIN_IRI, a[0].v)


def _bnode(a, c):
    if a:
        return Cell(Type(BNODE), a[0].v)
    return Cell(Type(BNODE), F.concat(F.lit("g"), F.substring(F.sha2(c.seed(), 256), 1, 24)))


def _uuid_text(c: Context) -> Column:
    h = F.sha2(c.seed(), 256)
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))


def _strdt(a, c):
    text, dt = a[0].v, a[1]
    is_iri = dt.part("k") == URI
    value = F.when(is_iri, text)
    name = dt.v
    ints, reals = value.try_cast("decimal(38,0)").cast("string"), value.try_cast("double").cast("string")
    lowered = F.lower(value)
    shown = (
        F.when(name.isin(*INTEGERS), F.coalesce(F.when(value.rlike(r"^[+-]?\d+$"), ints), value))
        .when(name.isin(*NUMERIC), F.coalesce(reals, value))
        .when(name == BOOLEAN, F.when(lowered == "1", "true").when(lowered == "0", "false").when(lowered.isin("true", "false"), lowered).otherwise(value))
        .otherwise(value)
    )
    return general(LITERAL, shown, name)


def _strlang(a, c):
    return general(LITERAL, F.when(a[1].v.isNotNull(), a[0].v), "", F.lower(a[1].v))


def _strlangdir(a, c):
    return general(LITERAL, F.when(a[1].v.isNotNull() & a[2].v.isNotNull(), a[0].v), "", F.lower(F.concat(a[1].v, F.lit("--"), a[2].v)))


def _substr(a, c):
    text, start = a[0].v, F.bround(number(a[1]), 0)
    # characters at places p with start <= p < start + length, counted from 1
    first = F.greatest(start, F.lit(1.0))
    if len(a) == 2:
        return plain(F.when(start.isNotNull(), text.substr(first.cast("int"), F.greatest(F.length(text), F.lit(0)))))
    end = start + F.bround(number(a[2]), 0)
    n = F.least(F.greatest(end - first, F.lit(0.0)), F.length(text).cast("double"))
    return plain(F.when(end.isNotNull(), text.substr(F.least(first, F.lit(2.0**31 - 1)).cast("int"), n.cast("int"))))


def _before(x: Column, y: Column) -> Column:
    at = F.position(y, x)
    return F.when(at > 0, x.substr(F.lit(1), at - 1)).when(at == 0, "")


def _after(x: Column, y: Column) -> Column:
    at = F.position(y, x)
    return F.when(at > 0, x.substr(at + F.length(y), F.length(x) + 1)).when(at == 0, "")


def _for_uri(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pattern(cell: Cell, flags: Cell | None) -> Column:
    prefix = F.lit("")
    if flags is not None:
        keep = F.regexp_replace(flags.v, "[^ims]", "")
        prefix = F.when(F.length(keep) > 0, F.concat(F.lit("(?"), keep, F.lit(")"))).when(keep.isNotNull(), "")
    named = F.regexp_replace(F.regexp_replace(cell.v, r"\(\?P<(\w+)>", "(?<$1>"), r"\(\?P=(\w+)\)", r"\\k<$1>")
    return F.concat(prefix, named)


def compiles(spark, pattern: str, flags: str = "", replacement: str = "") -> bool:
    """Whether a constant regular expression is one, and has the groups that a replacement names."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    keep = re.sub("[^ims]", "", flags)
    named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern))
    try:
        groups = spark._jvm.java.util.regex.Pattern.compile(f"(?{keep}){named}" if keep else named).matcher("").groupCount()
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return all(int(k) <= groups for k in re.findall(r"\\(\d)", replacement))


def _safe(pattern: Column, value: Column, c) -> Column:
    """``value``, or an error where ``pattern`` isn't a regular expression. Patterns known while planning were checked then."""
    if c.pattern_checked:
        return value
    known = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit(""))
    return F.when(known.isNotNull(), value)


def _regex(a, c):
    pattern = _pattern(a[1], a[2] if len(a) > 2 else None)
    return truth(_safe(pattern, F.rlike(a[0].v, pattern), c))


def _replace(a, c):
    # \1 is written $1, and a dollar sign stands for itself
    to = F.regexp_replace(F.regexp_replace(a[2].v, r"\$", r"\\\$"), r"\\(\d)", r"\$$1")
    pattern = _pattern(a[1], a[3] if len(a) > 3 else None)
    return plain(_safe(pattern, F.regexp_replace(a[0].v, pattern, to), c))


def _abs(a, c):
    t = a[0].type
    if t is not None and t.kind == LITERAL and t.dt in NUMERIC:
        if t.native in ("bigint", "double", "decimal(38,0)"):
            return Cell(t, F.abs(a[0].col))
        return Cell(t._replace(native="double"), F.abs(number(a[0])))
    ints = F.abs(whole(a[0])).cast("string")
    return general(LITERAL, F.coalesce(ints, F.abs(number(a[0])).cast("string")), a[0].part("dt"))


def _to_integer(f):
    def run(a, c):
        value = F.coalesce(whole(a[0]), f(number(a[0])).try_cast("decimal(38,0)"))
        return Cell(HUGE, value)

    return run


_MOMENT = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _moment(cell: Cell, group: int) -> Column:
    """A part of a written date; "" if the text has none, null if it isn't a date."""
    v = cell.v
    is_date = (cell.part("dt") == DATETIME) | (cell.part("dt") == XSD + "date")
    return F.when(is_date & v.rlike(_MOMENT), F.regexp_extract(v, _MOMENT, group))


def _date_part(group: int, native):
    def run(a, c):
        t = a[0].type
        if t is not None and t.native.startswith("timestamp"):
            return Cell(HUGE, native(a[0].col).cast("decimal(38,0)"))
        return Cell(HUGE, F.nullif(_moment(a[0], group), F.lit("")).try_cast("decimal(38,0)"))

    return run


def _seconds(a, c):
    t = a[0].type
    if t is not None and t.native.startswith("timestamp"):
        return Cell(Type(LITERAL, XSD + "decimal", native="double"), F.second(a[0].col).cast("double"))
    return Cell(Type(LITERAL, XSD + "decimal", native="double"), F.nullif(_moment(a[0], 6), F.lit("")).try_cast("double"))


def _timezone(a, c):
    z = F.nullif(_moment(a[0], 7), F.lit(""))
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    text = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), part(hours, "H"), part(minutes, "M"))
    zero = (z == "Z") | ((hours == 0) & (minutes == 0))
    return Cell(Type(LITERAL, XSD + "dayTimeDuration"), F.when(zero, "PT0S").when(z.isNotNull(), text))


def _tz(a, c):
    return plain(_moment(a[0], 7))


def _choose(a, c):
    t = unified([a[1].type, a[2].type])
    return Cell(t, F.when(boolean(a[0]), as_type(a[1], t)).otherwise(as_type(a[2], t)))


def _coalesce(a, c):
    if not a:
        return plain(F.lit(None).cast("string"))
    t = unified([x.type for x in a])
    return Cell(t, F.coalesce(*[as_type(x, t) for x in a]))


def _same_term(a, c):
    return truth(equal_terms(*a))


def _nt(cell: Cell) -> Column:
    """A term in N-Triples syntax."""
    v = cell.v
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    dt, lang = cell.part("dt"), cell.part("lang")
    tail = F.when(lang != "", F.concat(F.lit("@"), lang)).when(dt != "", F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    k = cell.part("k")
    return (
        F.when(k == URI, F.concat(F.lit("<"), v, F.lit(">")))
        .when(k == BNODE, F.concat(F.lit("_:"), v))
        .when(k == TRIPLE, F.concat(F.lit("<<( "), v, F.lit(" )>>")))
        .otherwise(F.concat(quoted, tail))
    )


def _triple(a, c):
    return Cell(Type(TRIPLE), F.concat(_nt(a[0]), F.lit(" "), _nt(a[1]), F.lit(" "), _nt(a[2])))


_NT = r'(?:<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\( .* \)>>)'


def _of_triple(group: int):
    def run(a, c):
        text = F.when(a[0].part("k") == TRIPLE, a[0].v)
        own = F.nullif(F.regexp_extract(text, rf"(?s)^({_NT}) ({_NT}) ({_NT})$", group), F.lit(""))
        body = F.regexp_extract(own, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
        plain_body = F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        kind = F.when(own.startswith("<<("), TRIPLE).when(own.startswith("<"), URI).when(own.startswith("_:"), BNODE).otherwise(LITERAL)
        v = (
            F.when(own.startswith("<<("), F.regexp_extract(own, r"(?s)^<<\( (.*) \)>>$", 1))
            .when(own.startswith("<"), F.regexp_extract(own, "^<(.*)>$", 1))
            .when(own.startswith("_:"), F.substring(own, 3, 1 << 30))
            .otherwise(plain_body)
        )
        dt = F.when(kind == LITERAL, F.regexp_extract(own, r"\^\^<([^>]*)>$", 1)).otherwise("")
        lang = F.when(kind == LITERAL, F.regexp_extract(own, r'"@([A-Za-z0-9-]+)$', 1)).otherwise("")
        return general(kind, F.when(own.isNotNull(), v), dt, lang)

    return run


def _unit(hexed: Column) -> Column:
    """13 hex digits as a number from 0 to 1."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / float(1 << 52)


BUILTINS = {
    "STR": lambda a, c: plain(a[0].v),
    "LANG": lambda a, c: plain(_language(a[0])),
    "LANGDIR": lambda a, c: plain(_direction(a[0])),
    "LANGMATCHES": _langmatches,
    "HASLANG": lambda a, c: truth(F.coalesce(a[0].part("lang") != "", F.lit(False))),
    "HASLANGDIR": lambda a, c: truth(F.coalesce(_direction(a[0]) != "", F.lit(False))),
    "DATATYPE": _datatype,
    "IRI": _iri,
    "URI": _iri,
    "BNODE": _bnode,
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "STRLANGDIR": _strlangdir,
    "UUID": lambda a, c: Cell(PLAIN_IRI, F.concat(F.lit("urn:uuid:"), _uuid_text(c))),
    "STRUUID": lambda a, c: plain(_uuid_text(c)),
    "RAND": lambda a, c: Cell(REAL, _unit(F.sha2(c.seed(), 256))),
    "NOW": lambda a, c: Cell(Type(LITERAL, DATETIME), F.lit(c.now)),
    "STRLEN": lambda a, c: Cell(HUGE, F.length(a[0].v).cast("decimal(38,0)")),
    "SUBSTR": _substr,
    "UCASE": _text(F.upper),
    "LCASE": _text(F.lower),
    "STRSTARTS": _test(lambda x, y: x.startswith(y)),
    "STRENDS": _test(lambda x, y: x.endswith(y)),
    "CONTAINS": _test(lambda x, y: x.contains(y)),
    "STRBEFORE": _text(_before),
    "STRAFTER": _text(_after),
    "ENCODE_FOR_URI": _text(_for_uri),
    "CONCAT": lambda a, c: plain(F.concat(*[x.v for x in a]) if a else F.lit("")),
    "REPLACE": _replace,
    "REGEX": _regex,
    "ABS": _abs,
    "ROUND": _to_integer(lambda x: F.bround(x, 0)),
    "CEIL": _to_integer(F.ceil),
    "FLOOR": _to_integer(F.floor),
    "YEAR": _date_part(1, F.year),
    "MONTH": _date_part(2, F.month),
    "DAY": _date_part(3, F.dayofmonth),
    "HOURS": _date_part(4, F.hour),
    "MINUTES": _date_part(5, F.minute),
    "SECONDS": _seconds,
    "TIMEZONE": _timezone,
    "TZ": _tz,
    "MD5": _text(F.md5),
    "SHA1": _text(F.sha1),
    "SHA256": _text(lambda x: F.sha2(x, 256)),
    "SHA384": _text(lambda x: F.sha2(x, 384)),
    "SHA512": _text(lambda x: F.sha2(x, 512)),
    "IF": _choose,
    "COALESCE": _coalesce,
    "SAMETERM": _same_term,
    "ISIRI": _kind(URI),
    "ISURI": _kind(URI),
    "ISBLANK": _kind(BNODE),
    "ISLITERAL": _kind(LITERAL),
    "ISTRIPLE": _kind(TRIPLE),
    "ISNUMERIC": lambda a, c: truth(F.when(a[0].is_null(), False).otherwise(F.coalesce(is_numeric(a[0]), F.lit(False)))),
    "TRIPLE": _triple,
    "SUBJECT": _of_triple(1),
    "PREDICATE": _of_triple(2),
    "OBJECT": _of_triple(3),
}


def _cast(dt: str):
    def run(a, c):
        text = a[0].v
        if dt in INTEGERS:
            return Cell(Type(LITERAL, dt, native="decimal(38,0)"), F.coalesce(whole(a[0]), F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("decimal(38,0)")), F.when(is_numeric(a[0]), number(a[0])).try_cast("decimal(38,0)")))
        if dt == BOOLEAN:
            low = F.lower(F.trim(text))
            return truth(F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(is_numeric(a[0]), number(a[0]) != 0))
        if dt in NUMERIC:
            return Cell(Type(LITERAL, dt, native="double"), F.trim(text).try_cast("double"))
        return Cell(Type(LITERAL, dt), text)

    return run


#: Datatype constructors, usable as functions: xsd:integer(?x) and the like.
CASTS = {dt: _cast(dt) for dt in (*NUMERIC, BOOLEAN, STRING, DATETIME, XSD + "date")}
