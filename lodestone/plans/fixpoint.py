"""Running components of rules.

A component that isn't recursive stays one lazy plan. A recursive one is a semi-naive loop: each round, every pattern over
a recursive predicate in turn reads only the last round's new triples. Rounds are written to the shared folder
(new triples only), so plans stay small and a lost executor costs a task, not the loop.
"""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Fragment, Graph, merged, predicate_struct, union_all
from ..model import IRI, Rule, Triple, Var
from ..terms import TERM, Cell, as_type, unified
from .compile import Compiler
from .stratify import ANY, heads, overlap, reads


def _derive(rule: Rule, compiler: Compiler, elements=None) -> list[tuple[str | None, Fragment]]:
    return compiler.head(rule, compiler.body(elements if elements is not None else rule.body))


def _by_predicate(made) -> dict[str | None, list[Fragment]]:
    out: dict[str | None, list[Fragment]] = {}
    for p, f in made:
        out.setdefault(p, []).append(f)
    return out


def _frame(spark, predicate: str | None, fragments: list[Fragment], types=None) -> tuple[DataFrame, object, object]:
    if predicate is ANY:
        return union_all([f.df.select("s", "p", "o") for f in fragments]), None, None
    df, s, o = merged(spark, fragments)
    if types is not None:
        df = df.select(as_type(Cell(s, F.col("s")), types[0]).alias("s"), as_type(Cell(o, F.col("o")), types[1]).alias("o"))
        s, o = types
    return df, s, o


def _put(graph: Graph, predicate: str | None, df: DataFrame, s, o) -> None:
    """``df`` has no row twice."""
    if predicate is ANY:
        graph.loose.append(df)
    else:
        graph.add(predicate, Fragment(df, F.col("s"), F.col("o"), s, o, unique=True))


def run_once(rules: list[Rule], graph: Graph, derived: Graph, compiler_for) -> None:
    """Rules that none of them reads from: all see ``graph`` as it is; results join both graphs."""
    made = []
    for r in rules:
        made += _derive(r, compiler_for(r, graph))
    for p, fragments in _by_predicate(made).items():
        df, s, o = _frame(graph.spark, p, fragments)
        if len(fragments) > 1 or not fragments[0].unique:
            df = df.distinct()
        _put(graph, p, df, s, o)
        _put(derived, p, df, s, o)


def _atoms(rule: Rule, recursive: set) -> list[Triple] | None:
    """Plain patterns over recursive predicates, or None if some recursive predicate is read in another way (inside a
    path, an EXISTS, a negation of the rule's own head): then the rule reads everything each round."""
    own = [el for el in rule.body if isinstance(el, Triple) and isinstance(el.predicate, (IRI, Var)) and overlap({el.predicate.value} if isinstance(el.predicate, IRI) else {ANY}, recursive)]
    rest = [el for el in rule.body if not any(el is x for x in own)]
    positive, negative = reads(rest)
    return None if overlap(positive | negative, recursive) else own


def run_loop(rules: list[Rule], graph: Graph, derived: Graph, compiler_for, scratch, max_iterations: int) -> None:
    recursive = set().union(*map(heads, rules))
    keys = sorted(recursive, key=lambda p: (p is ANY, p or ""))
    # a predicate known only from data may be any, so everything is general then
    loose = ANY in recursive
    known = graph.copy()
    if loose:
        whole = scratch.keep(graph.triples())
        known = Graph(graph.spark)
        known.loose = [whole]
    base = known.copy()
    types: dict[str, tuple] = {}

    def settle() -> None:
        """Types that the base and every rule's result agree on, general where they don't."""
        for p in keys:
            found = base.scan(p)
            if found:
                types[p] = (unified([f.s_type for f in found]), unified([f.o_type for f in found]))
        while True:
            # a rule says nothing of its result's types before it has any input
            ready = [r for r in rules if all(p in types for p in recursive & reads(r.body)[0])]
            trial = _by_predicate([x for r in ready for x in _derive(r, compiler_for(r, typed({})))])
            changed = False
            for p, fragments in trial.items():
                want = (unified([f.s_type for f in fragments]), unified([f.o_type for f in fragments]))
                now = types.get(p)
                agreed = want if now is None else tuple(a if a == b else None for a, b in zip(now, want))
                changed |= agreed != now
                types[p] = agreed
            if not changed:
                break
        for p in keys:
            types.setdefault(p, (None, None))

    def typed(found: dict) -> Graph:
        """The base with recursive predicates as one fragment each: what was there and what was found."""
        g = base.copy()
        if loose:
            g.loose = [*base.loose, *[df for dfs in found.values() for df in dfs]]
            return g
        for p in keys:
            frames = list(found.get(p, ()))
            if p in types:
                own = base.scan(p)
                if own:
                    frames.insert(0, _frame(g.spark, p, own, types[p])[0])
                g.fragments.pop(p, None)
                shape = {"s": types[p][0], "o": types[p][1]}
                nothing = g.spark.range(0).select(*[F.lit(None).cast(t.native if t else TERM).alias(c) for c, t in shape.items()])
                g.add_pairs(p, union_all(frames or [nothing]), *types[p])
        return g

    if not loose:
        settle()
    found: dict = {p: [] for p in keys}
    delta: dict = {}
    atoms = {id(r): _atoms(r, recursive) for r in rules}
    for turn in range(max_iterations):
        now = typed(found)
        made = []
        for r in rules:
            own = atoms[id(r)]
            if turn == 0 or own is None:
                made += _derive(r, compiler_for(r, now))
                continue
            for el in own:
                p = el.predicate.value if isinstance(el.predicate, IRI) else ANY
                for q, fragment in delta.items():
                    if q is not ANY and p is not ANY and q != p:
                        continue
                    if p is ANY and q is not ANY:
                        continue
                    compiler = compiler_for(r, now)
                    copy = replace(el)
                    compiler.instead[id(copy)] = fragment if q is not ANY or p is ANY else _of(fragment, p)
                    elements = [copy if x is el else x for x in r.body]
                    made += _derive(r, compiler, elements)
        delta = {}
        for p, fragments in _by_predicate(made).items():
            if loose and p is not ANY:
                df, s, o = _frame(graph.spark, p, fragments)
                df = df.select(Cell(s, F.col("s")).struct().alias("s"), predicate_struct(p).alias("p"), Cell(o, F.col("o")).struct().alias("o"))
                delta.setdefault(ANY, []).append(df)
            elif loose:
                delta.setdefault(ANY, []).append(_frame(graph.spark, p, fragments)[0])
            else:
                delta.setdefault(p, []).append(_frame(graph.spark, p, fragments, types[p])[0])
        fresh_delta: dict = {}
        for p, frames in delta.items():
            new = union_all(frames).distinct()
            old = now.triples(False) if p is ANY else _old(now, p)
            if old is not None:
                new = new.join(old, new.columns, "left_anti")
            new = scratch.keep(new)
            if not new.isEmpty():
                t = (None, None) if p is ANY else types[p]
                found.setdefault(p, []).append(new)
                fresh_delta[p] = Fragment(new, F.col("s"), F.col("o"), *t)
        delta = fresh_delta
        if not delta:
            break
        for p, frames in found.items():
            if len(frames) > 12:  # few, larger tables
                found[p] = [scratch.keep(union_all(frames[:-1])), frames[-1]]
    else:
        warnings.warn(f"rules stopped after {max_iterations} iterations without a fixpoint", RuntimeWarning, stacklevel=3)
    for p, frames in found.items():
        if frames:
            df, t = union_all(frames), (None, None) if p is ANY else types[p]
            _put(graph, p, df, *t)
            _put(derived, p, df, *t)


def _old(graph: Graph, p: str) -> DataFrame | None:
    return graph.fragments[p][0].pairs() if graph.fragments.get(p) else None


def _of(fragment: Fragment, predicate: str) -> Fragment:
    """The part of new general triples that has one predicate."""
    own = fragment.df.where(F.col("p.v") == predicate)
    return Fragment(own, F.col("s"), F.col("o"), None, None)


def _general(fragments: list[Fragment], p: str) -> list[DataFrame]:
    return [f.pairs().select(Cell(f.s_type, F.col("s")).struct().alias("s"), predicate_struct(p).alias("p"), Cell(f.o_type, F.col("o")).struct().alias("o")) for f in fragments]


def known(graph: Graph, predicates: set) -> DataFrame | None:
    """The graph's triples of some predicates (ANY: all) as general (s, p, o)."""
    if ANY in predicates:
        return graph.triples(False)
    frames = [df for p in sorted(predicates) for df in _general(graph.scan(p), p)]
    return union_all(frames) if frames else None


def unknown(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Rows of ``new`` whose triple isn't in ``old``, which is read once and, next to few new rows, not shuffled."""
    if old is None:
        return new
    met = old.join(new.select("s", "p", "o"), ["s", "p", "o"], "left_semi")
    return new.join(met, ["s", "p", "o"], "left_anti")


def rounds(rules: dict[int, Rule], graph: Graph, delta: DataFrame | None, compiler_for, scratch, max_iterations: int):
    """Semi-naive rounds over general triples: yields each round's new ones (s, p, o, rule), with every rule that derives
    them then. ``delta``: triples of ``graph`` that are new to it; None: all are, so the first round runs whole
    rules. ``graph`` gets the new triples. A rule that reads in ways other than plain patterns runs as a whole."""
    written = set().union(*map(heads, rules.values())) if rules else set()
    watched = written if delta is None else {ANY}
    atoms = {i: _atoms(r, watched) for i, r in rules.items()}
    own: list[DataFrame] = []
    for _ in range(max_iterations):
        made = []
        for i, r in rules.items():
            derived: list = []
            if delta is None or atoms[i] is None:
                derived = _derive(r, compiler_for(r, graph))
            else:
                for el in atoms[i]:
                    compiler, copy, new = compiler_for(r, graph), replace(el), Fragment(delta, F.col("s"), F.col("o"), None, None)
                    compiler.instead[id(copy)] = _of(new, el.predicate.value) if isinstance(el.predicate, IRI) else new
                    derived += _derive(r, compiler, [copy if x is el else x for x in r.body])
            for p, f in derived:
                df = f.df.select("s", "p", "o") if p is ANY else _general([f], p)[0]
                made.append(df.withColumn("rule", F.lit(i)))
        if not made:
            return
        new = scratch.keep(union_all(made).distinct())
        new = scratch.keep(unknown(new, known(graph, written)))
        if new.isEmpty():
            return
        yield new
        delta = scratch.keep(new.select("s", "p", "o").distinct())
        graph.loose.append(delta)
        own.append(delta)
        if len(own) > 8:  # few, larger tables
            graph.loose = [df for df in graph.loose if not any(df is x for x in own)]
            own = [scratch.keep(union_all(own))]
            graph.loose += own
    warnings.warn(f"rules stopped after {max_iterations} iterations without a fixpoint", RuntimeWarning, stacklevel=3)
