"""Rule engine: parse, order, run."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, empty, union_all
from .model import Rule, RuleSet, check_rule
from .parser import parse_body, parse_rules
from .plans.compile import Compiler, Rows
from .plans.fixpoint import rounds, run_loop, run_once
from .plans.stratify import desugar, levels, steps, strata
from .storage import Scratch
from .terms import Cell


class RuleEngine:
    """Evaluates a rule set over graphs.

    functions: IRI -> callable from cells to a cell, for custom functions in expressions.
    strict: rules are checked first and heads that no graph can hold are errors.
    compat: blank nodes in bodies are constants and a variable met twice in a pattern isn't an equality.
    """

    def __init__(self, rule_set: RuleSet | str, max_iterations: int = 1000, functions: dict[str, Callable] | None = None, strict: bool = False, compat: bool = False):
        self.rule_set = parse_rules(rule_set, strict) if isinstance(rule_set, str) else rule_set
        self.rules = desugar(self.rule_set)
        self.max_iterations, self.functions, self.compat = max_iterations, functions or {}, compat
        if strict:
            for r in self.rules:
                check_rule(r)

    # what is known without data

    def get_rule_count(self) -> int:
        return len(self.rules)

    def get_stratum_count(self) -> int:
        return len(strata(self.rules))

    def get_stratum_info(self) -> list[dict]:
        return [{"stratum": k, "rules": list(own), "rule_count": len(own)} for k, own in enumerate(strata(self.rules))]

    def get_rule_stratum(self, rule: int) -> int:
        """A rule's stratum, -1 if there is no such rule."""
        return levels(self.rules)[rule] if 0 <= rule < len(self.rules) else -1

    # evaluation

    def _compilers(self, spark: SparkSession, scratch: Scratch):
        now = datetime.datetime.now(datetime.UTC).isoformat()  # one moment for a whole evaluation
        numbers = {id(r): str(k) for k, r in enumerate(self.rules)}

        def make(rule: Rule, graph: Graph) -> Compiler:
            return Compiler(spark, graph, scratch, self.functions, now, numbers.get(id(rule), ""), self.compat, self.max_iterations)

        return make

    def evaluate(self, graph: Graph, inplace: bool = True, results_only: bool = False) -> Graph:
        """The graph with everything derivable. ``inplace``: the given graph object gets the new triples as well.
        ``results_only``: just the triples that the given graph doesn't have (not together with ``inplace``)."""
        if inplace and results_only:
            raise ValueError("results_only needs inplace=False")
        spark = graph.spark
        scratch = Scratch(spark)
        whole, derived = graph.copy(), Graph(spark)
        if self.rule_set.data:
            whole.add_triples(self.rule_set.data)
            derived.add_triples(self.rule_set.data)
        compiler_for = self._compilers(spark, scratch)
        for part in steps(self.rules):
            rules = [self.rules[i] for i in part.rules]
            if part.recursive:
                run_loop(rules, whole, derived, compiler_for, scratch, self.max_iterations)
            else:
                run_once(rules, whole, derived, compiler_for)
        if results_only:
            return _new(derived, graph)
        if inplace:
            graph.fragments, graph.loose = whole.fragments, whole.loose
            return graph
        return whole

    def evaluate_with_provenance(self, graph: Graph, inplace: bool = True) -> tuple[Graph, DataFrame]:
        """The graph and (s, p, o, rule, stratum): each rule that derives a triple in the round it is first new. All rules
        of a stratum see the same triples in a round."""
        spark = graph.spark
        scratch = Scratch(spark)
        whole = graph.copy()
        if self.rule_set.data:
            whole.add_triples(self.rule_set.data)
        compiler_for = self._compilers(spark, scratch)
        records: list[DataFrame] = []
        for k, own in enumerate(strata(self.rules)):
            for new in rounds({i: self.rules[i] for i in own}, whole, None, compiler_for, scratch, self.max_iterations):
                records.append(new.select("s", "p", "o", "rule", F.lit(k).alias("stratum")))
        log = union_all(records) if records else empty(spark).withColumns({"rule": F.lit(0), "stratum": F.lit(0)})
        if inplace:
            graph.fragments, graph.loose = whole.fragments, whole.loose
            return graph, log
        return whole, log

    def extend(self, graph: Graph, new: DataFrame) -> DataFrame:
        """What follows from general triples ``new`` (s, p, o) together with ``graph``, to which rules without negation were
        applied before: only derivations that use something new are looked at. ``graph`` gets ``new`` and the results."""
        scratch = Scratch(graph.spark)
        graph.loose.append(new)
        made = rounds(dict(enumerate(self.rules)), graph, new, self._compilers(graph.spark, scratch), scratch, self.max_iterations)
        found = [r.select("s", "p", "o").distinct() for r in made]
        return union_all(found) if found else empty(graph.spark)

    def solve(self, body, graph: Graph) -> Rows:
        """Solutions of a body (elements, or ``{ ... }`` text) over a graph."""
        if isinstance(body, str):
            body = parse_body(body, self.rule_set.prefixes)
        return self._compilers(graph.spark, Scratch(graph.spark))(Rule((), tuple(body)), graph).body(body)

    def select(self, body, graph: Graph, **columns: str) -> DataFrame:
        """Distinct native values: name="variable" or name="variable:spark type"; IRIs of table rows become their keys."""
        rows = self.solve(body, graph)
        out = native(rows, columns)
        # solutions that differ in a key that is all there are different rows already
        return out if rows.key is not None and rows.key <= _kept(rows, columns) else out.distinct()


def native(rows: Rows, columns: dict[str, str]) -> DataFrame:
    out = []
    for name, spec in columns.items():
        v, _, kind = spec.partition(":")
        cell = rows.cell(v)
        col = cell.col if cell.type is not None and (kind or not cell.type.template) else cell.v
        out.append((col.try_cast(kind) if kind else col).alias(name))
    return rows.df.select(*out)


def _kept(rows: Rows, columns: dict[str, str]) -> set[str]:
    """Variables whose different values are different in the result."""
    out = set()
    for spec in columns.values():
        v, _, kind = spec.partition(":")
        t = rows.cells[v][1]
        if t is not None and kind in ("", t.native) and not t.native.startswith("timestamp"):
            out.add(v)
    return out


def _new(derived: Graph, graph: Graph) -> Graph:
    """Derived triples that the graph doesn't have; predicates it can't have are left as they are."""
    out = Graph(graph.spark)
    for p, fragments in derived.fragments.items():
        if not graph.scan(p):
            out.fragments[p] = fragments
            continue
        mine, theirs = Graph(graph.spark), Graph(graph.spark)
        mine.fragments[p], theirs.fragments[p] = fragments, graph.scan(p)
        (a, sa, oa), (b, sb, ob) = mine.pairs(p), theirs.pairs(p)
        s, o = sa if sa == sb else None, oa if oa == ob else None
        shape = lambda df, ts, to: df.select((F.col("s") if ts == s else Cell(ts, F.col("s")).struct()).alias("s"), (F.col("o") if to == o else Cell(to, F.col("o")).struct()).alias("o"))  # noqa: E731, B023
        out.add_pairs(p, shape(a, sa, oa).distinct().join(shape(b, sb, ob), ["s", "o"], "left_anti"), s, o)
    if derived.loose:
        rest = Graph(graph.spark)
        rest.loose = derived.loose
        out.loose = rest.minus(graph).loose
    return out


def relation(graph: Graph, predicate: str, s: str = "", o: str = "", names: tuple[str, str] = ("s", "o")) -> DataFrame:
    """A predicate's distinct pairs as native values; s and o name Spark types ("" for text)."""
    df, ts, to = graph.pairs(predicate)
    rows = Rows(df, {"s": ("s", ts), "o": ("o", to)})
    columns = {names[0]: f"s:{s}" if s else "s", names[1]: f"o:{o}" if o else "o"}
    found = graph.scan(predicate)
    out = native(rows, columns)
    once = len(found) == 1 and found[0].unique and (_kept(rows, columns) == {"s", "o"} or found[0].source is not None and "s" in _kept(rows, columns))
    return out if once else out.distinct()


def evaluate_rules(rule_set: RuleSet | str, graph: Graph, inplace: bool = True, max_iterations: int = 1000) -> Graph:
    return RuleEngine(rule_set, max_iterations).evaluate(graph, inplace)


