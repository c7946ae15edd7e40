"""Command line: parse, eval, analyze.

    python -m lodestone.cli eval family.rules data.ttl -o out.ttl
"""

from __future__ import annotations

import argparse
import sys

from .engine import RuleEngine
from .graph import Graph
from .model import WellFormednessError, check_rule
from .namespaces import Namespaces
from .parser import ParseError, parse_file
from .plans.stratify import StratificationError, dependencies, desugar, heads, reads
from .sources import read_graph, write_graph

SHOWN = 50


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def summary(rule_set) -> list[str]:
    return [
        f"rules: {len(rule_set.rules)}",
        f"data triples: {len(rule_set.data)}",
        f"declarations: {len(rule_set.declarations)}",
        f"prefixes: {len(rule_set.prefixes)}",
        *([f"base: {rule_set.base}"] if rule_set.base else []),
        *([f"version: {rule_set.version}"] if rule_set.version else []),
        *[f"imports: {i}" for i in rule_set.imports],
    ]


def _short(names: set, ns: Namespaces) -> str:
    return ", ".join(sorted("*" if n is None else ns.abbreviate(n) for n in names)) or "-"


def run_parse(args) -> int:
    rule_set = parse_file(args.rules, args.strict)
    print("\n".join(summary(rule_set)))
    if args.verbose:
        ns = Namespaces(rule_set.prefixes)
        for k, r in enumerate(desugar(rule_set)):
            print(f"rule {k} ({r.source}): {_short(heads(r), ns)} <- {_short(set().union(*reads(r.body)), ns)}")
            try:
                check_rule(r)
            except WellFormednessError as e:
                print(f"  not well-formed: {e}")
    return 0


def run_analyze(args) -> int:
    rule_set = parse_file(args.rules)
    engine, ns = RuleEngine(rule_set), Namespaces(rule_set.prefixes)
    positive, negative = dependencies(engine.rules)
    print(f"{engine.get_rule_count()} rules in {engine.get_stratum_count()} strata")
    for info in engine.get_stratum_info():
        print(f"stratum {info['stratum']}: {info['rule_count']} rules")
        if args.show_layers:
            for i in info["rules"]:
                print(f"  rule {i}: {_short(heads(engine.rules[i]), ns)}; reads from {sorted(positive[i])}, negates {sorted(negative[i])}")
    return 0


def run_eval(args) -> int:
    rule_set = parse_file(args.rules)
    spark = _session()
    data = read_graph(spark, args.data, args.format)
    engine = RuleEngine(rule_set, args.max_iterations)
    before = data.count()
    log = None
    if args.verbose:
        result, log = engine.evaluate_with_provenance(data, inplace=False)
    else:
        result = engine.evaluate(data, inplace=False)
    after = result.count()
    print(f"{before} triples, {after - before} inferred, {after} in all")
    if log is not None:
        for r in log.orderBy("stratum", "rule", "s.v", "p.v", "o.v").limit(SHOWN).collect():
            print(f"  stratum {r.stratum} rule {r.rule}: {r.s.v} {r.p.v} {r.o.v}")
    if args.output:
        out: Graph = result.minus(data) if args.inferred_only else result
        write_graph(out, args.output, args.output_format, Namespaces(rule_set.prefixes))
        print(f"written: {args.output}")
    return 0


def run_shacl(args) -> int:
    print("shape files hold no rules that this engine evaluates; use rule text", file=sys.stderr)
    return 2


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description="Rules over graphs, on Spark.")
    parser.add_argument("-v", "--verbose", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse", help="check a rule file and say what is in it")
    p.add_argument("rules")
    p.add_argument("--strict", action="store_true")
    p.set_defaults(run=run_parse)
    p = sub.add_parser("eval", help="evaluate rules over data")
    p.add_argument("rules")
    p.add_argument("data")
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--format", help="the data's format")
    p.add_argument("--output-format")
    p.add_argument("--inferred-only", action="store_true")
    p.add_argument("--max-iterations", type=int, default=1000)
    p.set_defaults(run=run_eval)
    p = sub.add_parser("analyze", help="strata of a rule file")
    p.add_argument("rules")
    p.add_argument("--show-layers", action="store_true")
    p.set_defaults(run=run_analyze)
    p = sub.add_parser("shacl", help="(not evaluated)")
    p.add_argument("shapes")
    p.set_defaults(run=run_shacl)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (ParseError, StratificationError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
