"""Value semantics: truth, equality, order and arithmetic of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BOOLEAN, DECIMAL, DOUBLE, FLOAT, HUGE, INTEGER, INTEGERS, LITERAL, NUMERIC, STRING, Cell, Type, general, truth

_TRUTH_NUMBERS = (INTEGER, DECIMAL, DOUBLE, FLOAT)


def _known(cell: Cell, test) -> Column:
    """A test of the type as a constant where the type is known."""
    return F.lit(test(cell.type))


def is_numeric(cell: Cell) -> Column:
    if cell.type is not None:
        return _known(cell, lambda t: t.kind == LITERAL and t.dt in NUMERIC)
    return (cell.part("k") == LITERAL) & cell.part("dt").isin(*NUMERIC)


def number(cell: Cell) -> Column:
    """As a double; null for what isn't a number."""
    t = cell.type
    if t is not None:
        if t.kind != LITERAL or t.dt not in NUMERIC:
            return F.lit(None).cast("double")
        return cell.col.try_cast("double")
    return F.when(is_numeric(cell), cell.part("v").try_cast("double"))


def whole(cell: Cell) -> Column:
    """As a 38-digit integer; null for what isn't one."""
    t = cell.type
    if t is not None:
        if t.kind != LITERAL or t.dt not in INTEGERS:
            return F.lit(None).cast("decimal(38,0)")
        return cell.col.try_cast("decimal(38,0)")
    return F.when((cell.part("k") == LITERAL) & cell.part("dt").isin(*INTEGERS), cell.part("v").try_cast("decimal(38,0)"))


def holds(cell: Cell) -> Column:
    """Effective boolean value for a place where null and false mean the same (a filter, a join's condition): bare tests, so
    comparisons of columns reach the source."""
    t = cell.type
    if t is not None:
        if t.kind != LITERAL:
            return F.lit(False)
        if t.dt == BOOLEAN:
            return cell.col if t.native == "boolean" else F.lower(cell.v).isin("true", "1")
        if t.dt in _TRUTH_NUMBERS:
            return (number(cell) != 0) & ~F.isnan(number(cell))
        if t.dt in ("", STRING):
            return F.length(cell.v) > 0
        return F.lit(False)
    dt, v = cell.part("dt"), cell.part("v")
    value = v.try_cast("double")
    return (
        F.when(cell.part("k") != LITERAL, False)
        .when(dt == BOOLEAN, F.lower(v).isin("true", "1"))
        .when(dt.isin(*_TRUTH_NUMBERS), (value != 0) & ~F.isnan(value))
        .when(dt.isin("", STRING), F.length(v) > 0)
        .otherwise(False)
    )


def boolean(cell: Cell) -> Column:
    """Effective boolean value; an error counts as false, so it is never null."""
    return F.coalesce(holds(cell), F.lit(False))


def _both_known(a: Cell, b: Cell) -> bool:
    return a.type is not None and b.type is not None


def _exact(a: Cell, b: Cell) -> bool:
    """Both are known integers: compared without going through doubles."""
    return _both_known(a, b) and a.type.kind == b.type.kind == LITERAL and a.type.dt in INTEGERS and b.type.dt in INTEGERS


def equal(a: Cell, b: Cell) -> Column:
    """``=``: the same term, equal numbers, or literals of one datatype (plain and xsd:string count as one) with equal
    text; null if either is an error."""
    if _both_known(a, b):
        ta, tb = a.type, b.type
        if ta == tb and ta.native != "string" and not (ta.dt in (DOUBLE, FLOAT)):
            return a.col == b.col
        if _exact(a, b):
            return whole(a) == whole(b)
        if ta.kind == tb.kind == LITERAL and ta.dt in NUMERIC and tb.dt in NUMERIC:
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.coalesce(number(a) == number(b), a.v == b.v))
        same_kind = ta.kind == tb.kind and (ta.kind != LITERAL or ta.dt == tb.dt or {ta.dt, tb.dt} <= {"", STRING})
        return a.v == b.v if same_kind else F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    ka, kb, da, db = a.part("k"), b.part("k"), a.part("dt"), b.part("dt")
    plain = F.when(da == STRING, "").otherwise(da) == F.when(db == STRING, "").otherwise(db)
    numbers = is_numeric(a) & is_numeric(b)
    ints = whole(a) == whole(b)
    return (
        F.when(a.is_null() | b.is_null(), F.lit(None).cast("boolean"))
        .when(numbers & ints.isNotNull(), ints)
        .when(numbers, F.coalesce(number(a) == number(b), a.v == b.v))
        .when((ka == LITERAL) & (kb == LITERAL), plain & (a.v == b.v))
        .otherwise((ka == kb) & (a.v == b.v))
    )


def compare(op: str, a: Cell, b: Cell) -> Column:
    """Order: by value if both are numbers, else by code points of the text, whatever the terms are."""
    by = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if _both_known(a, b):
        if a.type == b.type and a.type.native in ("bigint", "double", "timestamp", "timestamp_ntz"):
            return by(a.col, b.col)
        if _exact(a, b):
            return by(whole(a), whole(b))
        if a.type.kind == b.type.kind == LITERAL and a.type.dt in NUMERIC and b.type.dt in NUMERIC:
            return by(number(a), number(b))
        return by(a.v, b.v)
    numbers = is_numeric(a) & is_numeric(b)
    exact = by(whole(a), whole(b))
    return (
        F.when(a.is_null() | b.is_null(), F.lit(None).cast("boolean"))
        .when(numbers & exact.isNotNull(), exact)
        .when(numbers, by(number(a), number(b)))
        .otherwise(by(a.v, b.v))
    )


def _result_type(a: Column, b: Column) -> Column:
    """Datatype of a sum or product, widest first."""
    out = F.lit(INTEGER)
    for dt in (DECIMAL, FLOAT, DOUBLE):
        out = F.when((a == dt) | (b == dt), dt).otherwise(out)
    return out


def arithmetic(op: str, a: Cell, b: Cell) -> Cell:
    """Integers stay exact up to 38 digits, decimals are doubles; what isn't a number, overflows or divides by zero is an error."""
    exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
    real = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / F.nullif(y, F.lit(0.0))}[op]
    numeric = lambda t: t.kind == LITERAL and t.dt in NUMERIC
    if any(c.type is not None and not numeric(c.type) for c in (a, b)):
        return Cell(Type(LITERAL, DOUBLE, native="double"), F.lit(None).cast("double"))
    if _both_known(a, b):
        dts = {a.type.dt, b.type.dt}
        if op == "/":
            return Cell(Type(LITERAL, DOUBLE if DOUBLE in dts else DECIMAL, native="double"), real(number(a), number(b)))
        wide = next((d for d in (DOUBLE, FLOAT, DECIMAL) if d in dts), None)
        if wide:
            return Cell(Type(LITERAL, wide, native="double"), real(number(a), number(b)))
        return Cell(HUGE, exact(whole(a), whole(b)).cast("decimal(38,0)"))
    da, db = a.part("dt"), b.part("dt")
    if op == "/":
        dt = F.when((da == DOUBLE) | (db == DOUBLE), DOUBLE).otherwise(DECIMAL)
        return general(LITERAL, real(number(a), number(b)).cast("string"), dt)
    dt = _result_type(da, db)
    ints = exact(whole(a), whole(b)).cast("decimal(38,0)").cast("string")
    return general(LITERAL, F.when(dt == INTEGER, ints).otherwise(real(number(a), number(b)).cast("string")), dt)


def negated(a: Cell) -> Cell:
    """Unary minus keeps the datatype."""
    t = a.type
    if t is not None:
        if t.kind != LITERAL or t.dt not in NUMERIC:
            return Cell(Type(LITERAL, DOUBLE, native="double"), F.lit(None).cast("double"))
        if t.dt in INTEGERS:
            return Cell(t._replace(native="decimal(38,0)"), -whole(a))
        return Cell(t._replace(native="double"), -number(a))
    whole_text, real_text = (-whole(a)).cast("string"), (-number(a)).cast("string")
    return general(LITERAL, F.when(a.part("dt").isin(*INTEGERS), whole_text).otherwise(real_text), a.part("dt"))


def apply(name: str, args: list[Cell]) -> Cell:
    """An operator by its sign."""
    match name:
        case "||":
            return truth(boolean(args[0]) | boolean(args[1]))
        case "&&":
            return truth(boolean(args[0]) & boolean(args[1]))
        case "!":
            return truth(F.when(~args[0].is_null(), ~boolean(args[0])))
        case "=":
            return truth(equal(*args))
        case "!=":
            return truth(~equal(*args))
        case "<" | "<=" | ">" | ">=":
            return truth(compare(name, *args))
        case "+" | "-" | "*" | "/":
            return arithmetic(name, *args)
        case "neg":
            return negated(args[0])
        case "pos":
            return negated(negated(args[0]))
        case "IN":
            hit = F.lit(False)
            for x in args[1:]:
                hit = hit | F.coalesce(equal(args[0], x), args[0].is_null() & x.is_null())
            return truth(hit)
    raise ValueError(f"no operator {name}")

