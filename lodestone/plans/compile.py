"""Bodies and heads to DataFrames.

A body is a fold over its elements. At each point all rows bind the same variables, so variables are columns
(named by number: Spark's names ignore case, rule variables don't) and joins are equalities on the shared ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtins import BUILTINS, CASTS, Context, compiles
from ..functions.values import apply, boolean, equal, holds
from ..graph import Fragment, Graph, merged, union_all
from ..model import (
    IRI, Alternative, Bind, Blank, Call, Exists, Filter, Inverse, Literal, Negated, Not, Op, Repeat, Rule, Sequence, Triple, TripleTerm,
    Var, variables,
)
from ..operators.closure import closure, compose, reach
from ..storage import Scratch
from ..terms import BNODE, Cell, Type, as_type, constant, equal_terms, error, row_of, truth, unified

_names = count()


def fresh() -> str:
    return f"c{next(_names)}"


@dataclass
class Rows:
    """Solutions: a frame and, for each bound variable, its column and type (columns are never null)."""

    df: DataFrame
    cells: dict[str, tuple[str, Type | None]] = field(default_factory=dict)
    unit: bool = False  # the one empty solution
    key: frozenset[str] | None = None  # variables that no two solutions agree on, where such are known

    def cell(self, v: str) -> Cell:
        name, t = self.cells[v]
        return Cell(t, F.col(name))

    def none(self) -> Rows:
        return replace(self, df=self.df.where(F.lit(False)), unit=False)


class Compiler:
    """graph: what patterns read; ``instead`` gives single patterns something else (a round's new triples)."""

    def __init__(self, spark: SparkSession, graph: Graph, scratch: Scratch, functions=None, now: str = "", rule: str = "", compat: bool = False, max_iterations: int = 1000):
        self.spark, self.graph, self.scratch, self.compat, self.max_iterations = spark, graph, scratch, compat, max_iterations
        self.functions = {**CASTS, **(functions or {})}
        self.context = Context(now=now, rule=rule)
        self.instead: dict[int, Fragment] = {}  # id of a triple -> what it reads

    # solutions

    def start(self) -> Rows:
        return Rows(self.spark.range(1).select(), unit=True)

    def body(self, elements, rows: Rows | None = None) -> Rows:
        rows = rows or self.start()
        elements, k = list(elements), 0
        while k < len(elements):
            run = k
            while run < len(elements) and isinstance(elements[run], Triple):
                run += 1
            if run > k:
                rows = self.patterns(elements[k:run], rows)
                k = run
                continue
            el = elements[k]
            match el:
                case Filter(e):
                    rows = self.filter(e, rows)
                case Bind(e, v):
                    rows = self.bind(e, v.name, rows)
                case Not(inner):
                    rows = self.without(inner, rows, True)
            k += 1
        return rows

    # patterns

    def variable(self, x) -> str | None:
        if isinstance(x, Var):
            return x.name
        if isinstance(x, Blank) and not self.compat:  # in a body a blank node is a variable that nothing else names
            return f"_:{x.label}"
        return None

    def named(self, x) -> set[str]:
        """Variables of a place, those inside a triple term as well."""
        if isinstance(x, TripleTerm):
            return set().union(*map(self.named, (x.subject, x.predicate, x.object)))
        return {self.variable(x)} - {None}

    def key(self, t: Triple) -> frozenset[str] | None:
        """Variables that no two solutions of a pattern agree on, where such are known before it is read."""
        if not isinstance(t.predicate, IRI) or id(t) in self.instead or any(isinstance(x, TripleTerm) and variables(x) for x in (t.subject, t.object)):
            return None
        found = self.matching(self.graph.scan(t.predicate.value), t)
        if len(found) != 1 or not found[0].unique:
            return None
        if found[0].source is not None and self.variable(t.subject):
            return frozenset([self.variable(t.subject)])
        return frozenset(v for v in map(self.variable, (t.subject, t.object)) if v)

    def patterns(self, triples: list[Triple], rows: Rows) -> Rows:
        """Joins patterns, those connected with what is bound first, of these ones that add no rows (a key of theirs is bound)
        before ones that may, and ones that bind less before ones that bind more; patterns of one subject in one table are one scan."""
        todo = list(triples)
        while todo:
            def rank(t: Triple):
                own = set().union(*map(self.named, (t.subject, t.predicate, t.object)))
                constants = sum(not self.named(x) for x in (t.subject, t.object))
                key = self.key(t)
                return (bool(own & set(rows.cells)) or rows.unit, isinstance(t.predicate, IRI), constants, key is not None and key <= set(rows.cells), -len(own - set(rows.cells)))

            first = max(todo, key=rank)
            todo.remove(first)
            star = [first]
            if (s := self.variable(first.subject)) and self.one_table(first):
                same = [t for t in todo if self.variable(t.subject) == s and self.one_table(t) is not None and self.one_table(t) is self.one_table(first)]
                objects = {self.variable(first.object)} | {s}
                for t in same:
                    o = self.variable(t.object)
                    if o is None or o not in objects:
                        star.append(t)
                        objects.add(o)
                todo = [t for t in todo if not any(t is x for x in star)]
            rows = self.join(rows, self.star(star) if len(star) > 1 else self.pattern(first, rows))
        return rows

    def one_table(self, t: Triple):
        """The source that alone holds a pattern's predicate, if its rows have one subject each."""
        if not isinstance(t.predicate, IRI) or id(t) in self.instead:
            return None
        found = self.graph.scan(t.predicate.value)
        found = self.matching(found, t)
        return found[0].source if len(found) == 1 else None

    def star(self, triples: list[Triple]) -> Rows:
        fragments = [self.matching(self.graph.scan(t.predicate.value), t)[0] for t in triples]
        s = self.variable(triples[0].subject)
        columns = {s: (fresh(), fragments[0].s_type)}
        picked, tests = [fragments[0].s.alias(columns[s][0])], []
        for t, f in zip(triples, fragments):
            name, o = fresh(), self.variable(t.object)
            picked.append(f.o.alias(name))
            tests.append(F.col(name).isNotNull())
            if o is None:
                tests.append(self.is_constant(Cell(f.o_type, F.col(name)), t.object))
            else:
                columns[o] = (name, f.o_type)
        df = fragments[0].df.select(*picked)
        for test in [F.col(columns[s][0]).isNotNull(), *tests]:
            df = df.where(test)
        key = frozenset([s]) if all(f.unique for f in fragments) else None
        return Rows(df.select(*[n for n, _ in columns.values()]), columns, key=key)

    def is_constant(self, cell: Cell, term) -> Column:
        """Equality with a ground term, on the typed column wherever that is possible."""
        k, v, dt, lang = row_of(term)
        t = cell.type
        if t is None:
            return (cell.col.getField("k") == k) & (cell.col.getField("v") == v) & (cell.col.getField("dt") == dt) & (cell.col.getField("lang") == lang)
        if (t.kind, t.dt, t.lang) != (k, dt, lang) or t.template and not v.startswith(t.template):
            return F.lit(False)
        if t.template:
            key = v[len(t.template) :]
            if t.native == "bigint":
                return cell.col == int(key) if key.lstrip("-").isdigit() and str(int(key)) == key else F.lit(False)
            return cell.col == F.lit(key)
        return equal_terms(cell, constant(term))

    def matching(self, fragments: list[Fragment], t: Triple) -> list[Fragment]:
        """Fragments that can hold a pattern's constants at all."""
        def can(type_: Type | None, x, fixed: str | None = None) -> bool:
            if type_ is None or self.variable(x) is not None or not isinstance(x, (IRI, Literal, Blank)):
                return True
            k, v, dt, lang = row_of(x)
            return (type_.kind, type_.dt, type_.lang) == (k, dt, lang) and v.startswith(type_.template) and fixed in (None, v)

        return [f for f in fragments if can(f.s_type, t.subject) and can(f.o_type, t.object, f.constant)]

    def pattern(self, t: Triple, rows: Rows | None = None) -> Rows:
        for place in ("subject", "object"):
            x = getattr(t, place)
            if isinstance(x, TripleTerm) and variables(x):
                return self.inside(t, place, x, rows)
        if isinstance(t.predicate, Var):
            return self.any_predicate(t)
        if id(t) in self.instead:
            df, s, o = merged(self.spark, [self.instead[id(t)]])
        elif isinstance(t.predicate, IRI):
            df, s, o = merged(self.spark, self.matching(self.graph.scan(t.predicate.value), t))
        else:
            df, s, o = self.path(t.predicate, t.subject, t.object, rows)
        return replace(self.bound(df, [(t.subject, "s", s), (t.object, "o", o)]), key=self.key(t))

    def bound(self, df: DataFrame, places) -> Rows:
        """Constants become filters, variables columns, a variable met twice an equality."""
        cells: dict[str, tuple[str, Type | None]] = {}
        names, tests = [], []
        for x, column, t in places:
            own = Cell(t, F.col(column))
            v = self.variable(x)
            if v is None:
                tests.append(self.is_constant(own, x))
            elif v in cells and not self.compat:
                first = next((c, ct) for y, c, ct in places if self.variable(y) == v)
                tests.append(equal_terms(Cell(first[1], F.col(first[0])), own))
            else:
                cells[v] = (fresh(), t)
                names = [n for n in names if n[1] != v] + [(column, v)]
        for test in tests:
            df = df.where(test)
        return Rows(df.select(*[F.col(c).alias(cells[v][0]) for c, v in names]), cells)

    def inside(self, t: Triple, place: str, term: TripleTerm, rows: Rows | None) -> Rows:
        """A pattern with variables in a triple term: the term is matched as a whole and taken apart."""
        whole = fresh()
        outer = replace(t, **{place: Var(whole)})
        if id(t) in self.instead:
            self.instead[id(outer)] = self.instead[id(t)]
        found = self.parts(term, whole, self.pattern(outer, rows))
        cells = {v: c for v, c in found.cells.items() if v != whole}
        return Rows(found.df.select(*[n for n, _ in cells.values()]) if cells else found.df, cells)

    def parts(self, term: TripleTerm, whole: str, rows: Rows) -> Rows:
        rows = replace(rows, df=rows.df.where(holds(BUILTINS["ISTRIPLE"]([rows.cell(whole)], self.context))))
        for name, x in (("SUBJECT", term.subject), ("PREDICATE", term.predicate), ("OBJECT", term.object)):
            cell = BUILTINS[name]([rows.cell(whole)], self.context)
            v = self.variable(x)
            if isinstance(x, TripleTerm) and variables(x):
                v = fresh()
            if v is None:
                rows = replace(rows, df=rows.df.where(equal_terms(cell, constant(x))))
            elif v in rows.cells:
                rows = replace(rows, df=rows.df.where(equal_terms(cell, rows.cell(v))))
            else:
                column = fresh()
                rows = Rows(rows.df.withColumn(column, cell.col).where(F.col(column).isNotNull()), {**rows.cells, v: (column, cell.type)})
            if isinstance(x, TripleTerm) and variables(x):
                rows = self.parts(x, v, rows)
                rows = replace(rows, cells={k: c for k, c in rows.cells.items() if k != v})
        return rows

    def any_predicate(self, t: Triple) -> Rows:
        df = self.instead[id(t)].df if id(t) in self.instead else self.graph.triples(False)
        return self.bound(df, [(t.subject, "s", None), (t.predicate, "p", None), (t.object, "o", None)])

    # paths: relations of (s, o), as sets

    def path(self, path, subject=None, obj=None, rows: Rows | None = None) -> tuple[DataFrame, Type | None, Type | None]:
        """subject, obj: the ends, where they are at hand; rows: solutions so far, whose values bound ends have."""
        match path:
            case IRI(value):
                return merged(self.spark, self.graph.scan(value))
            case Inverse(inner):
                df, s, o = self.path(inner)
                return df.select(F.col("o").alias("s"), F.col("s").alias("o")), o, s
            case Sequence(parts):
                df, s, o = self.path(parts[0])
                for p in parts[1:]:
                    right, m, end = self.path(p)
                    t = o if o == m else None
                    df = df.select("s", as_type(Cell(o, F.col("o")), t).alias("o"))
                    right = right.select(as_type(Cell(m, F.col("s")), t).alias("s"), "o")
                    df, o = compose(df, right), end
                return df.distinct(), s, o
            case Alternative(parts):
                return self.joined([self.path(p) for p in parts])
            case Negated(forward, backward):
                out = []
                every = self.graph.triples(False)
                if forward or not backward:
                    out.append(every.where(~F.col("p.v").isin(*[i.value for i in forward])).select("s", "o"))
                if backward:
                    out.append(every.where(~F.col("p.v").isin(*[i.value for i in backward])).select(F.col("o").alias("s"), F.col("s").alias("o")))
                return union_all(out).distinct(), None, None
            case Repeat(inner, least, once):
                df, s, o = self.path(inner)
                if s != o:
                    df, s, o = df.select(Cell(s, F.col("s")).struct().alias("s"), Cell(o, F.col("o")).struct().alias("o")), None, None
                starts, stops = (x is not None and self.variable(x) is None for x in (subject, obj))
                if not once and starts:
                    df = reach(df.where(self.is_constant(Cell(s, F.col("s")), subject)), df, self.scratch, self.max_iterations)
                elif not once and stops:
                    turned = df.select(F.col("o").alias("s"), F.col("s").alias("o"))
                    df = reach(turned.where(self.is_constant(Cell(s, F.col("s")), obj)), turned, self.scratch, self.max_iterations)
                    df = df.select(F.col("o").alias("s"), F.col("s").alias("o"))
                elif not once:
                    df = closure(df, self.scratch, self.max_iterations)
                if least == 0:
                    same, t = self.identity(subject, obj, rows, s)
                    df = df.select(as_type(Cell(s, F.col("s")), t).alias("s"), as_type(Cell(o, F.col("o")), t).alias("o"))
                    df, s, o = df.unionByName(same.select(F.col("n").alias("s"), F.col("n").alias("o"))), t, t
                return df.distinct(), s, o
        raise TypeError(f"not a path: {path!r}")

    def identity(self, subject, obj, rows: Rows | None, t: Type | None) -> tuple[DataFrame, Type | None]:
        """Values (column n) that a path of no steps joins with themselves, of type ``t`` if that can be: the constant at an
        end, else the values that an end is bound to, else every node."""
        for x in (subject, obj):
            if x is not None and self.variable(x) is None:
                key = self.key_of(x, t) if t is not None else None
                own = constant(x).struct() if key is None else key
                return self.spark.range(1).select(own.alias("n")), t if key is not None else None
        for x in (subject, obj):
            v = self.variable(x) if x is not None else None
            if rows is not None and v in rows.cells:
                cell = rows.cell(v)
                kept = t if cell.type == t else None
                return rows.df.select(as_type(cell, kept).alias("n")).distinct(), kept
        return self.graph.nodes(), None

    def key_of(self, term, t: Type) -> Column | None:
        """A ground term as a value of a typed column, if it can be one."""
        k, v, dt, lang = row_of(term)
        key = v[len(t.template) :]
        if (t.kind, t.dt, t.lang) != (k, dt, lang) or not v.startswith(t.template) or t.native not in ("string", "bigint"):
            return None
        if t.native == "string":
            return F.lit(key)
        return F.lit(int(key)).cast("bigint") if key.lstrip("-").isdigit() and str(int(key)) == key else None

    def joined(self, parts) -> tuple[DataFrame, Type | None, Type | None]:
        s, o = unified([p[1] for p in parts]), unified([p[2] for p in parts])
        frames = [df.select(as_type(Cell(ts, F.col("s")), s).alias("s"), as_type(Cell(to, F.col("o")), o).alias("o")) for df, ts, to in parts]
        return union_all(frames).distinct(), s, o

    # joins

    def aligned(self, left: Rows, right: Rows) -> tuple[Rows, Rows, list[str]]:
        """Shared variables, with columns that can be compared directly."""
        shared = [v for v in right.cells if v in left.cells]
        for v in shared:
            (a, ta), (b, tb) = left.cells[v], right.cells[v]
            if ta != tb:
                both = ta is not None and tb is not None and (ta.kind, ta.dt, ta.lang) == (tb.kind, tb.dt, tb.lang)
                t = Type(ta.kind, ta.dt, ta.lang) if both else None
                value = lambda c: c.v if t else c.struct()  # noqa: E731, B023
                na, nb = fresh(), fresh()
                left = replace(left, df=left.df.withColumn(na, value(left.cell(v))), cells={**left.cells, v: (na, t)})
                right = replace(right, df=right.df.withColumn(nb, value(right.cell(v))), cells={**right.cells, v: (nb, t)})
        return left, right, shared

    def join(self, left: Rows, right: Rows) -> Rows:
        if left.unit:
            return right
        left, right, shared = self.aligned(left, right)
        if not shared:
            df = left.df.crossJoin(right.df)
        else:
            df = left.df.join(right.df, [F.col(left.cells[v][0]) == F.col(right.cells[v][0]) for v in shared])
        cells = {**right.cells, **left.cells}
        key = left.key | right.key if left.key is not None and right.key is not None else None
        return Rows(df.select(*[n for n, _ in cells.values()]), cells, key=key)

    def without(self, elements, rows: Rows, negated: bool) -> Rows:
        """NOT and EXISTS at the top of a body: an anti or semi join on the shared variables. Filters inside that use
        outer variables are part of the join's condition."""
        if any(isinstance(el, Filter) and _has_exists(el.expression) for el in elements):
            return self.flagged(elements, rows, negated)
        inner, residual = self.start(), []
        elements, k = list(elements), 0
        while k < len(elements):
            run = k
            while run < len(elements) and isinstance(elements[run], Triple):
                run += 1
            if run > k:  # patterns side by side: those of one row are one scan
                inner = self.patterns(elements[k:run], inner)
                k = run
                continue
            el = elements[k]
            if variables(el) <= set(inner.cells):
                inner = self.filter(el.expression, inner)
            else:
                # a variable bound on neither side is unbound here, whatever binds it later
                known = set(inner.cells) | set(rows.cells)
                residual.append((el.expression, known))
            k += 1
        how = "left_anti" if negated else "left_semi"
        if inner.unit:
            hit = F.lit(True)
            for e, known in residual:
                hit = hit & boolean(self.expression(e, rows, known=known))
            return replace(rows, df=rows.df.where(~hit if negated else hit))
        left, right, shared = self.aligned(rows, inner)
        both = Rows(left.df, {**right.cells, **left.cells})
        on = [F.col(left.cells[v][0]) == F.col(right.cells[v][0]) for v in shared]
        on += [self.condition(e, both, known=known) for e, known in residual]
        if not on:
            return replace(rows, df=rows.df.join(right.df.limit(1).select(F.lit(1).alias(fresh())), F.lit(True), how))
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        df = left.df.join(right.df, condition, how)
        return Rows(df.select(*[n for n, _ in left.cells.values()]) if left.cells else df, left.cells, key=left.key)

    def exists_flag(self, elements, rows: Rows) -> tuple[Rows, Column]:
        """A column that says whether a group has a solution with each row: the group is solved for the distinct values of
        the outer variables it names, and what matched is joined back."""
        named = set().union(set(), *map(variables, elements))
        keys = {v: c for v, c in rows.cells.items() if v in named}
        flag = fresh()
        if not keys:
            found = self.body(elements).df.limit(1).agg(F.count(F.lit(1)).alias(flag))
            return Rows(rows.df.crossJoin(found), rows.cells), F.col(flag) > 0
        base = Rows(rows.df.select(*[n for n, _ in keys.values()]).distinct(), dict(keys))
        got = self.body(elements, base)
        new = {v: fresh() for v in keys}
        hit = got.df.select(*[as_type(got.cell(v), keys[v][1]).alias(new[v]) for v in keys]).distinct().withColumn(flag, F.lit(True))
        df = rows.df.join(hit, [F.col(keys[v][0]) == F.col(new[v]) for v in keys], "left")
        return Rows(df, rows.cells), F.coalesce(F.col(flag), F.lit(False))

    def flagged(self, elements, rows: Rows, negated: bool) -> Rows:
        got, flag = self.exists_flag(elements, rows)
        df = got.df.where(~flag if negated else flag)
        return Rows(df.select(*[n for n, _ in rows.cells.values()]), rows.cells, key=rows.key)

    # filters, assignments, expressions

    def filter(self, e, rows: Rows) -> Rows:
        match e:
            case Op("&&", args):
                for a in args:
                    rows = self.filter(a, rows)
                return rows
            case Exists(elements, negated):
                return self.without(elements, rows, negated)
            case Op("!", (Exists(elements, negated),)):
                return self.without(elements, rows, not negated)
        rows, flags = self.flags(e, rows)
        df = rows.df.where(self.condition(e, rows, flags))
        return Rows(df.select(*[n for n, _ in rows.cells.values()]) if rows.cells else df, rows.cells, key=rows.key)

    def condition(self, e, rows: Rows, flags=None, known=None) -> Column:
        """An expression where null and false mean the same, as plain as its types allow: comparisons of columns reach the
        source, equalities between two sides become join keys."""
        again = lambda x: self.condition(x, rows, flags, known)
        match e:
            case Op("&&", (a, b)):
                return again(a) & again(b)
            case Op("||", (a, b)):
                return again(a) | again(b)
            case Op("!", (Op("=" | "!=" | "<" | "<=" | ">" | ">=" as name, args),)):
                return ~apply(name, [self.expression(x, rows, flags, known) for x in args]).col
            case Op("IN", (Var(), *_)) | Op("!", (Op("IN", (Var(), *_)),)):
                inner = e if e.name == "IN" else e.args[0]
                one, *others = [self.expression(x, rows, flags, known) for x in inner.args]
                if all(isinstance(x, (IRI, Literal)) for x in inner.args[1:]) and others and one.type is not None and inner.args[0].name in (rows.cells if known is None else known & set(rows.cells)):
                    hit = one.col.isin(*[x.col for x in others]) if all(x.type == one.type for x in others) else None
                    if hit is None:
                        for x in others:
                            hit = equal(one, x) if hit is None else hit | equal(one, x)
                    return hit if inner is e else ~hit
        return holds(self.expression(e, rows, flags, known))

    def flags(self, e, rows: Rows) -> tuple[Rows, dict[int, Column]]:
        """Columns for the EXISTS that stand inside an expression."""
        out: dict[int, Column] = {}
        match e:
            case Exists(elements, negated):
                rows, flag = self.exists_flag(elements, rows)
                out[id(e)] = ~flag if negated else flag
            case Op(_, args) | Call(_, args):
                for a in args:
                    rows, more = self.flags(a, rows)
                    out |= more
        return rows, out

    def bind(self, e, v: str, rows: Rows) -> Rows:
        if v in rows.cells:
            return rows.none()  # assigning what is bound has no solution
        got, flags = self.flags(e, rows)
        value, name = self.expression(e, got, flags), fresh()
        df = got.df.select(*[n for n, _ in rows.cells.values()], value.col.alias(name)).where(F.col(name).isNotNull())
        return Rows(df, {**rows.cells, v: (name, value.type)}, key=rows.key)

    def expression(self, e, rows: Rows, flags=None, known=None) -> Cell:
        flags = flags or {}
        again = lambda x: self.expression(x, rows, flags, known)
        bound = lambda name: name in rows.cells and (known is None or name in known)
        match e:
            case Var(name):
                return rows.cell(name) if bound(name) else error()
            case IRI() | Literal():
                return constant(e)
            case Blank(label):
                return Cell(Type(BNODE), F.lit(label))
            case TripleTerm(s, p, o):
                return BUILTINS["TRIPLE"]([again(s), again(p), again(o)], self.context)
            case Exists():
                return truth(flags[id(e)])
            case Op(name, args):
                return apply(name, [again(a) for a in args])
            case Call("BOUND", (Var(name),)):
                return truth(F.lit(bound(name)))
            case Call(IRI(value), args):
                f = self.functions.get(value)
                if f is None:
                    return error()
                cells = [again(a) for a in args]
                return f(cells, self.context) if value in CASTS else f(*cells)
            case Call(str() as name, args) if name in BUILTINS:
                cells = [again(a) for a in args]
                self.context.row = [rows.cell(v).v for v in sorted(rows.cells)]
                self.context.pattern_checked = False
                if name in ("REGEX", "REPLACE") and all(isinstance(a, Literal) for a in args[1:]):
                    pattern, *rest = [a.value for a in args[1:]]
                    to = rest.pop(0) if name == "REPLACE" else ""
                    if not compiles(self.spark, pattern, rest[0] if rest else "", to):
                        return error()
                    self.context.pattern_checked = True
                return BUILTINS[name](cells, self.context)
        return error()

    # heads

    def head(self, rule: Rule, rows: Rows) -> list[tuple[str | None, Fragment]]:
        """(predicate, fragment) for each template all of whose variables are bound; a predicate only known from
        data is None, its fragment a frame of general (s, p, o)."""
        out = []
        for t in rule.head:
            parts = []
            for x in (t.subject, t.predicate, t.object):
                match x:
                    case Var(name):
                        parts.append(rows.cell(name) if name in rows.cells else None)
                    case Blank(label):
                        parts.append(Cell(Type(BNODE), F.lit(label)))
                    case TripleTerm():
                        missing = variables(x) - set(rows.cells)
                        parts.append(None if missing else self.expression(x, rows))
                    case _:
                        parts.append(constant(x))
            if any(p is None for p in parts):
                continue
            s, p, o = parts
            if isinstance(t.predicate, IRI):
                df = rows.df.select(s.col.alias("s"), o.col.alias("o")).where("s IS NOT NULL AND o IS NOT NULL")
                named = {x.name for x in (t.subject, t.object) if isinstance(x, Var)}
                unique = rows.key is not None and rows.key <= named
                out.append((t.predicate.value, Fragment(df, F.col("s"), F.col("o"), s.type, o.type, unique=unique)))
            else:
                df = rows.df.select(s.struct().alias("s"), p.struct().alias("p"), o.struct().alias("o")).dropna()
                out.append((None, Fragment(df, F.col("s"), F.col("o"), None, None)))
        return out


def _has_exists(e) -> bool:
    match e:
        case Exists():
            return True
        case Op(_, args) | Call(_, args):
            return any(map(_has_exists, args))
    return False


