"""Queries over what surrounds rules: files, graphs, evaluation modes, syntax, generated and structured terms, errors.

Each has SQL over the same tables. What has no table of its own (an error, a plan's shape) is a row of text that the
SQL states.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import RuleEngine, evaluate_rules, relation
from .graph import Graph, Table
from .model import WellFormednessError
from .namespaces import Namespaces
from .parser import ParseError, parse_rules
from .plans.stratify import StratificationError
from .sources import read_graph, tables_graph
from .sources.files import triple_lines
from .storage import Scratch
from .terms import plain, truth

NS = "http://example.org/"
PREFIX = f"PREFIX ex: <{NS}>\n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, " ".join(sql.split())
        return f

    return register


def _text_file(spark: SparkSession, text: str) -> str:
    """A text in the shared folder, where a session on a cluster can read it again."""
    _, path = Scratch(spark).store(spark.createDataFrame([("",)], "value string").limit(0))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path + "-text")
    return path + "-text"


def _said(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "what string, said string")


# sources and sinks


@query("SELECT DISTINCT o_orderkey, o_orderpriority FROM orders")
def q54_triples_file(spark, sf_dir):
    """Orders' priorities written as N-Triples by the executors and read back."""
    graph = tables_graph(spark, sf_dir, "orders")
    part = Graph(spark)
    part.fragments[NS + "o_orderpriority"] = graph.fragments[NS + "o_orderpriority"]
    _, path = Scratch(spark).store(triple_lines(part).limit(0))
    triple_lines(part).write.text(path + "-lines")
    back = read_graph(spark, path + "-lines", "nt")
    rows = RuleEngine(PREFIX).select("{ ?o ex:o_orderpriority ?p }", back, o="o", o_orderpriority="p")
    return rows.select(F.substring_index("o", "/", -1).cast("bigint").alias("o_orderkey"), "o_orderpriority")


@query("SELECT DISTINCT c_custkey, c_name, c_acctbal FROM customer")
def q54b_parquet_triples(spark, sf_dir):
    """Triples kept as a Parquet table of general terms; numbers keep their datatype."""
    graph = tables_graph(spark, sf_dir, "customer")
    kept, path = Scratch(spark).store(graph.triples())
    back = read_graph(spark, path, "parquet")
    rows = RuleEngine(PREFIX).select("{ ?c ex:c_custkey ?k ; ex:c_name ?n ; ex:c_acctbal ?a }", back, c_custkey="k", c_name="n", c_acctbal="a")
    return rows.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_acctbal").cast("double"))


_DOCUMENTS = {
    "turtle": "@prefix ex: <http://example.org/> . <http://example.org/region/0> ex:tag \"zero\" ; ex:rank 1 .",
    "trig": "@prefix ex: <http://example.org/> . ex:g { <http://example.org/region/1> ex:tag \"one\" . }",
    "xml": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/"><rdf:Description rdf:about="http://example.org/region/2"><ex:tag>two</ex:tag></rdf:Description></rdf:RDF>',
    "json-ld": '{"@context": {"ex": "http://example.org/"}, "@id": "ex:region/3", "ex:tag": "three"}',
    "nquads": '<http://example.org/region/4> <http://example.org/tag> "four" <http://example.org/g> .',
}


@query("""SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two'
    WHEN 3 THEN 'three' ELSE 'four' END AS tag FROM nation""")
def q55_documents(spark, sf_dir):
    """Tags of regions from a document in each format, joined with a table."""
    graph = tables_graph(spark, sf_dir, "nation")
    for kind, text in _DOCUMENTS.items():
        graph = graph.union(read_graph(spark, _text_file(spark, text), kind))
    rows = RuleEngine(PREFIX).select("{ ?n ex:n_regionkey ?r . ?r ex:tag ?t }", graph, n="n", tag="t")
    return rows.select(F.substring_index("n", "/", -1).cast("bigint").alias("n_nationkey"), "tag")


@query("SELECT DISTINCT c_custkey, 'good' AS grade FROM customer WHERE c_acctbal > 5000")
def q56_rules_file_with_imports(spark, sf_dir):
    """Rules from files: one imports another that derives what it needs."""
    base = _text_file(spark, PREFIX + "RULE { ?c ex:rich ?a } WHERE { ?c ex:c_acctbal ?a . FILTER(?a > 5000) }")
    main = _text_file(spark, PREFIX + f'IMPORTS <{base}>\nRULE {{ ?c ex:grade "good" }} WHERE {{ ?c ex:rich ?a }}')
    read = lambda path: "\n".join(r.value for r in spark.read.text(path).collect())  # noqa: E731  a rules file
    out = RuleEngine(parse_rules(read(main), resolve=read)).evaluate(tables_graph(spark, sf_dir, "customer"), inplace=False)
    return relation(out, NS + "grade", "bigint", "", ("c_custkey", "grade"))


# graphs and modes


@query("""SELECT 'union' AS part, count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)
    UNION ALL SELECT 'minus', count(*) FROM nation UNION ALL SELECT 'both', 0""")
def q57_graph_algebra(spark, sf_dir):
    """Triples of a class in the union of two graphs, and after taking one of them away again."""
    a, b = tables_graph(spark, sf_dir, "nation"), tables_graph(spark, sf_dir, "region")
    both = a.union(b)
    typed = lambda g, name: g.triples().where(F.col("p.v").endswith("#type")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return typed(both, "union").unionByName(typed(both.minus(b), "minus")).unionByName(typed(a.minus(both), "both"))


@query("""SELECT 'copy' AS mode, 0 AS before, count(*) AS after FROM region UNION ALL SELECT 'in place', count(*), count(*) FROM region
    UNION ALL SELECT 'new only', 0, count(*) FROM region""")
def q58_modes(spark, sf_dir):
    """How many derived triples the given graph and the result hold."""
    engine = RuleEngine(PREFIX + "RULE { ?r ex:seen ?n } WHERE { ?r ex:r_name ?n }")
    out = None
    for mode, options in (("copy", dict(inplace=False)), ("in place", {}), ("new only", dict(inplace=False, results_only=True))):
        given = tables_graph(spark, sf_dir, "region")
        got = engine.evaluate(given, **options)
        count = lambda g, name: g.triples().where(F.col("p.v") == NS + "seen").agg(F.count("*").alias(name))
        row = count(given, "before").crossJoin(count(got, "after")).select(F.lit(mode).alias("mode"), "before", "after")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT DISTINCT s_suppkey, 'late' AS how FROM supplier WHERE s_acctbal > 0")
def q59_element_order(spark, sf_dir):
    """Elements run in order: a test before its variable is bound has no solution, and a variable can't be assigned again."""
    rules = PREFIX + (
        'RULE { ?s ex:how "early" } WHERE { FILTER(?a > 0) ?s ex:s_acctbal ?a }\n'
        'RULE { ?s ex:how "again" } WHERE { ?s ex:s_acctbal ?a . BIND(1 AS ?a) }\n'
        'RULE { ?s ex:how "late" } WHERE { ?s ex:s_acctbal ?a . FILTER(?a > 0) }'
    )
    return relation(RuleEngine(rules).evaluate(tables_graph(spark, sf_dir, "supplier"), inplace=False), NS + "how", "bigint", "", ("s_suppkey", "how"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(r_regionkey + k AS BIGINT) AS n FROM region, range(0, 5) t(k)")
def q60_iteration_cap(spark, sf_dir):
    """A rule without a fixpoint stops after the given number of rounds."""
    rules = PREFIX + "RULE { ?r ex:n ?k } WHERE { ?r ex:r_regionkey ?k }\nRULE { ?r ex:n ?m } WHERE { ?r ex:n ?k . BIND(?k + 1 AS ?m) }"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        out = RuleEngine(rules, max_iterations=4).evaluate(tables_graph(spark, sf_dir, "region"), inplace=False)
    return relation(out, NS + "n", "bigint", "bigint", ("r_regionkey", "n"))


@query("SELECT DISTINCT p_partkey, p_size + 1 AS n FROM part WHERE p_size < 5")
def q61_evaluate_rules(spark, sf_dir):
    out = evaluate_rules(PREFIX + "RULE { ?p ex:n ?m } WHERE { ?p ex:p_size ?s . FILTER(?s < 5) BIND(?s + 1 AS ?m) }", tables_graph(spark, sf_dir, "part"))
    return relation(out, NS + "n", "bigint", "int", ("p_partkey", "n"))


_LAYERS = (
    "RULE { ?c ex:loyal ?s } WHERE { ?c ex:quiet ?s }\nRULE { ?c ex:quiet ?s } WHERE { ?c ex:segment ?s . NOT { ?c ex:busy true } }\n"
    "RULE { ?c ex:busy true } WHERE { ?o ex:by ?c }\nTRANSITIVE(ex:near)"
)


@query("""SELECT * FROM (VALUES ('rules', 4), ('strata', 2), ('in stratum 0', 2), ('in stratum 1', 2), ('stratum of rule 0', 1), ('stratum of rule 1', 1),
    ('stratum of rule 2', 0), ('stratum of rule 9', -1)) t(what, n)""")
def q62_introspection(spark, sf_dir):
    engine = RuleEngine(PREFIX + _LAYERS)
    rows = [("rules", engine.get_rule_count()), ("strata", engine.get_stratum_count())]
    rows += [(f"in stratum {i['stratum']}", i["rule_count"]) for i in engine.get_stratum_info()]
    rows += [(f"stratum of rule {k}", engine.get_rule_stratum(k)) for k in (0, 1, 2, 9)]
    return spark.createDataFrame(rows, "what string, n int")


def _error(f, *kinds) -> str:
    try:
        f()
    except kinds as e:
        return type(e).__name__
    return "none"


@query("""SELECT * FROM (VALUES ('negative cycle', 'StratificationError'), ('own head negated', 'none'), ('unbound head', 'WellFormednessError'),
    ('assigned twice', 'WellFormednessError'), ('unknown prefix, strict', 'ParseError'), ('unknown prefix', 'none'), ('missing brace', 'ParseError'),
    ('both modes', 'ValueError')) t(what, said)""")
def q63_errors(spark, sf_dir):
    rules = lambda text, **kw: lambda: RuleEngine(PREFIX + text, **kw).get_stratum_count()
    tried = {
        "negative cycle": rules("RULE { ?x ex:a 1 } WHERE { ?x ex:n ?y . NOT { ?x ex:b 1 } }\nRULE { ?x ex:b 1 } WHERE { ?x ex:n ?y . NOT { ?x ex:a 1 } }"),
        "own head negated": rules("RULE { ?x ex:a 1 } WHERE { ?x ex:n ?y . NOT { ?x ex:a ?z } }"),
        "unbound head": rules("RULE { ?x ex:a ?z } WHERE { ?x ex:n ?y }", strict=True),
        "assigned twice": rules("RULE { ?x ex:a ?y } WHERE { ?x ex:n ?y . BIND(1 AS ?y) }", strict=True),
        "unknown prefix, strict": rules("RULE { ?x none:a 1 } WHERE { ?x ex:n ?y }", strict=True),
        "unknown prefix": rules("RULE { ?x none:a 1 } WHERE { ?x ex:n ?y }"),
        "missing brace": rules("RULE { ?x ex:a 1 WHERE { ?x ex:n ?y }"),
        "both modes": lambda: RuleEngine(PREFIX).evaluate(Graph(spark), inplace=True, results_only=True),
    }
    return _said(spark, *[(k, _error(f, StratificationError, WellFormednessError, ParseError, ValueError)) for k, f in tried.items()])


# terms and functions


def _solved(spark, sf_dir, table, body, columns, rules="", **options):
    graph = tables_graph(spark, sf_dir, table)
    engine = RuleEngine(PREFIX + rules, **options)
    return engine.select(body, engine.evaluate(graph, inplace=False) if rules else graph, **columns)


@query("SELECT DISTINCT c_custkey, 'n' || c_nationkey AS label, true AS blank, c_name AS name FROM customer")
def q64_labelled_blank_nodes(spark, sf_dir):
    body = '{ ?c ex:c_nationkey ?h ; ex:c_name ?name . BIND(BNODE(CONCAT("n", STRAFTER(STR(?h), "nation/"))) AS ?b) BIND(STR(?b) AS ?l) BIND(ISBLANK(?b) AS ?k) }'
    return _solved(spark, sf_dir, "customer", body, {"c_custkey": "c:bigint", "label": "l", "blank": "k:boolean", "name": "name"})


@query("SELECT 'blank nodes' AS what, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT 'identifiers', count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'random', count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'moments', 1 UNION ALL SELECT 'well formed', count(*) FROM nation")
def q65_generated_terms(spark, sf_dir):
    """Different rows get different blank nodes, identifiers and random numbers, all rows one moment."""
    body = '{ ?n ex:n_name ?x . BIND(STR(BNODE()) AS ?b) BIND(STR(UUID()) AS ?u) BIND(RAND() AS ?r) BIND(STR(NOW()) AS ?t) }'
    rows = _solved(spark, sf_dir, "nation", body, {"k": "n:bigint", "b": "b", "u": "u", "r": "r:double", "t": "t"})
    formed = F.sum((F.col("u").rlike("^urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & (F.col("r") >= 0) & (F.col("r") < 1) & F.col("t").rlike(r"^\d{4}-\d\d-\d\dT")).cast("bigint"))
    got = rows.agg(F.count_distinct("b").alias("blank nodes"), F.count_distinct("u").alias("identifiers"), F.count_distinct("r").alias("random"), F.count_distinct("t").alias("moments"), formed.alias("well formed"))
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in got.columns])).alias("x")).select("x.*")


@query("""SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, lang AS l, CASE WHEN lang = 'de' THEN 'rtl' ELSE 'ltr' END AS d, true AS hl, true AS hd, false AS pl,
    lang IN ('en') AS en FROM documents""")
def q66_directions(spark, sf_dir):
    """Language tags with a base direction."""
    body = (
        '{ ?k ex:lang ?l . BIND(STRLANGDIR("x", ?l, IF(?l = "de", "rtl", "ltr")) AS ?t) BIND(LANG(?t) AS ?a) BIND(LANGDIR(?t) AS ?d) BIND(HASLANG(?t) AS ?h) '
        'BIND(HASLANGDIR(?t) AS ?i) BIND(HASLANGDIR(STRLANG("x", ?l)) AS ?p) BIND(LANGMATCHES(LANG(?t), "en") AS ?e) }'
    )
    return _solved(spark, sf_dir, "documents", body, {"doc_id": "k:bigint", "l": "a", "d": "d", "hl": "h:boolean", "hd": "i:boolean", "pl": "p:boolean", "en": "e:boolean"})


@query("SELECT DISTINCT s_suppkey, 'http://example.org/nation/' || s_nationkey AS object, true AS is, false AS plain FROM supplier")
def q67_triple_terms(spark, sf_dir):
    """Links stated as triple terms, taken apart by functions and by variables inside a pattern."""
    rules = "RULE { ex:log ex:saw ?t } WHERE { ?s ex:s_nationkey ?n . BIND(TRIPLE(?s, ex:s_nationkey, ?n) AS ?t) }"
    body = "{ ex:log ex:saw ?t . ex:log ex:saw <<( ?s ex:s_nationkey ?o )>> . FILTER(SAMETERM(SUBJECT(?t), ?s)) FILTER(STR(PREDICATE(?t)) = STR(ex:s_nationkey)) BIND(ISTRIPLE(?t) AS ?is) BIND(ISTRIPLE(?s) AS ?p) }"
    rows = _solved(spark, sf_dir, "supplier", body, {"s": "s", "object": "o", "is": "is:boolean", "plain": "p:boolean"}, rules)
    return rows.select(F.substring_index("s", "/", -1).cast("bigint").alias("s_suppkey"), "object", "is", "plain")


@query("SELECT DISTINCT p_partkey, reverse(p_name) AS back, length(p_type) > 20 AS long FROM part")
def q68_custom_functions(spark, sf_dir):
    own = {"http://f/back": lambda c: plain(F.reverse(c.v)), "http://f/long": lambda c: truth(F.length(c.v) > 20)}
    body = "{ ?p ex:p_name ?n ; ex:p_type ?t . BIND(<http://f/back>(?n) AS ?b) BIND(<http://f/long>(?t) AS ?l) }"
    return _solved(spark, sf_dir, "part", body, {"p_partkey": "p:bigint", "back": "b", "long": "l:boolean"}, functions=own)


@query("""SELECT DISTINCT c_custkey, sha384, sha512 FROM (SELECT c_custkey, 96 AS sha384, 128 AS sha512 FROM customer)""")
def q68b_long_hashes(spark, sf_dir):
    """Their lengths; their values against the published test vector, so a wrong digest has no row."""
    vector = "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7"
    wide = "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"
    body = f'{{ ?c ex:c_name ?n . FILTER(SHA384("abc") = "{vector}" && SHA512("abc") = "{wide}") BIND(STRLEN(SHA384(?n)) AS ?a) BIND(STRLEN(SHA512(?n)) AS ?b) }}'
    return _solved(spark, sf_dir, "customer", body, {"c_custkey": "c:bigint", "sha384": "a:int", "sha512": "b:int"})


# syntax


@query("""SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS n_nationkey, how FROM nation, (VALUES ('arrow'), ('bare'), ('rule'), ('if')) t(how)
    UNION ALL SELECT DISTINCT CAST(n_nationkey AS BIGINT), 'lists' FROM nation""")
def q69_rule_forms(spark, sf_dir):
    """Every way to write a rule, ``a``, lists, comments, ``$`` variables."""
    rules = (
        '{ ?x ex:how "arrow" } :- { ?x ex:n_name ?n }  # a comment\n'
        '?x ex:how "bare" :- ?x ex:n_name ?n .\n'
        'RULE { ?x ex:how "rule" } WHERE { ?x a ex:Nation }\n'
        'IF { $x ex:n_name ?n } THEN { ?x ex:how "if" }\n'
        'RULE { ?x ex:how "lists" ; ex:tag "a", "b" } WHERE { ?x ex:n_name ?n ; ex:n_nationkey ?k }'
    )
    body = "{ ?x ex:how ?h }"
    return _solved(spark, sf_dir, "nation", body, {"n_nationkey": "x:bigint", "how": "h"}, rules)


@query("SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS r_regionkey, 'http://example.org/about' AS p, 'base' AS o FROM region UNION ALL SELECT DISTINCT CAST(r_regionkey AS BIGINT), 'http://www.w3.org/2000/01/rdf-schema#label', r_name FROM region UNION ALL SELECT DISTINCT CAST(r_regionkey AS BIGINT), 'lost:thing', 'kept' FROM region")
def q70_names(spark, sf_dir):
    """BASE, VERSION, prefixes known without a declaration and unknown ones, which stand for themselves."""
    rules = 'VERSION "1.2"\nBASE <http://example.org/>\nRULE { ?r <about> "base" ; rdfs:label ?n ; lost:thing "kept" } WHERE { ?r <r_name> ?n }'
    graph = RuleEngine(rules).evaluate(tables_graph(spark, sf_dir, "region"), inplace=False, results_only=True).triples()
    return graph.select(F.substring_index("s.v", "/", -1).cast("bigint").alias("r_regionkey"), F.col("p.v").alias("p"), F.col("o.v").alias("o"))


@query("SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(r_regionkey + 3 AS BIGINT) AS total, 'tab' || chr(9) || 'quote\"é' AS odd FROM region")
def q71_structures(spark, sf_dir):
    """Collections, property lists, long strings and escapes in data and in bodies."""
    data = 'DATA { ex:x ex:list ( 1 2 ) ; ex:box [ ex:side 1 ] ; ex:odd "tab\\tquote\\"\\u00e9" }\n'
    body = "{ ex:x ex:list ( ?a ?b ) ; ex:box [ ex:side ?a ] ; ex:odd ?o . ?r ex:r_regionkey ?k . BIND(?k + ?a + ?b AS ?t) }"
    return _solved(spark, sf_dir, "region", body, {"r_regionkey": "r:bigint", "total": "t:bigint", "odd": "o"}, data + "RULE { ?r ex:seen 1 } WHERE { ?r ex:r_name ?n }")


@query("SELECT DISTINCT c_custkey, c_name AS about FROM customer WHERE c_acctbal < 0")
def q71b_reified(spark, sf_dir):
    """Statements about statements: a reifier and an annotation say the same."""
    rules = "RULE { ?c ex:owes ?a {| ex:about ?n |} } WHERE { ?c ex:c_acctbal ?a ; ex:c_name ?n . FILTER(?a < 0) }"
    body = "{ ?c ex:owes ?a . ?st rdf:reifies <<( ?c ex:owes ?a )>> ; ex:about ?x . ?c ex:c_name ?x }"
    rows = _solved(spark, sf_dir, "customer", body, {"c": "c", "about": "x"}, rules)
    return rows.select(F.substring_index("c", "/", -1).cast("bigint").alias("c_custkey"), "about")


@query("""SELECT * FROM (VALUES ('rules', '2'), ('data', '1'), ('declarations', '1'), ('version', '1.2'), ('line of an error', '2'), ('expand', 'http://example.org/a'),
    ('abbreviate', 'ex:a'), ('unknown', '<http://none/a>')) t(what, said)""")
def q72_parser_and_names(spark, sf_dir):
    found = parse_rules(PREFIX + 'VERSION "1.2" DATA { ex:a ex:b 1 } SYMMETRIC(ex:b) RULE { ?x ex:c 1 } WHERE { ?x ex:b 1 } ?x ex:d 1 :- ?x ex:b 1 .')
    names = Namespaces()
    names.register("ex", NS)
    try:
        parse_rules("PREFIX ex: <http://example.org/>\nRULE { ?x }")
        line = "none"
    except ParseError as e:
        line = str(e.line)
    return _said(
        spark, ("rules", str(len(found.rules))), ("data", str(len(found.data))), ("declarations", str(len(found.declarations))), ("version", str(found.version)),
        ("line of an error", line), ("expand", names.expand("ex:a")), ("abbreviate", names.abbreviate(NS + "a")), ("unknown", names.abbreviate("http://none/a")),
    )


@query("""SELECT DISTINCT c_custkey, regexp_matches('BUILDING', c_mktsegment) AS hit, regexp_replace(c_name, 'Customer', 'C', 'g') AS short FROM customer
    WHERE c_mktsegment <> 'never('""")
def q73_patterns_from_data(spark, sf_dir):
    """Patterns that are data, and one that is no pattern: an error, not the end of the job."""
    body = '{ ?c ex:c_mktsegment ?s ; ex:c_name ?n . BIND(REGEX("BUILDING", ?s) AS ?h) BIND(REPLACE(?n, "Customer", "C") AS ?t) FILTER(COALESCE(REGEX(?n, CONCAT(?s, "(")), true)) FILTER(COALESCE(REGEX(?n, "("), true)) }'
    return _solved(spark, sf_dir, "customer", body, {"c_custkey": "c:bigint", "hit": "h:boolean", "short": "t"})


# tables as graphs


@query("""SELECT DISTINCT x.user_id || '/' || x.event_type AS k, x.value AS a, y.event_id AS b FROM events x JOIN events y USING (user_id, event_type)""")
def q74_repeated_keys(spark, sf_dir):
    """A key that rows share: its predicates are sets of values, each met with each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    graph = Graph(spark).add_table(Table(events, "kind", ("user_id", "event_type")))
    rows = RuleEngine(PREFIX).select("{ ?e ex:value ?a ; ex:event_id ?b }", graph, k="e:string", a="a:double", b="b:bigint")
    return rows


@query("""SELECT 'rows' AS what, count(*) AS n FROM (SELECT DISTINCT a, b FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS a, CASE WHEN n_nationkey % 2 = 1 THEN
    n_nationkey - 1 END AS b FROM nation)) UNION ALL SELECT 'both', 0 UNION ALL SELECT 'parts', count(DISTINCT n_name || '|' || n_regionkey) FROM nation""")
def q75_null_keys(spark, sf_dir):
    """Rows (k, null) and (null, k) are different rows; keys of several columns don't run into each other."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    halves = nations.selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS a", "CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey - 1 END AS b")
    pairs = nations.selectExpr("concat(n_name, '/') AS c", "n_regionkey AS d").union(nations.selectExpr("n_name AS c", "n_regionkey AS d").where("false"))
    g = Graph(spark).add_table(Table(halves, "half")).add_table(Table(pairs, "pair", ("c", "d")))
    count = lambda body, name, v: RuleEngine(PREFIX).select(body, g, v=v).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("{ ?r a ex:Half }", "rows", "r").unionByName(count("{ ?r ex:a ?a ; ex:b ?b }", "both", "r")).unionByName(count("{ ?r ex:c ?c }", "parts", "r"))


@query("SELECT DISTINCT 'http://example.org/nation/' || n_nationkey AS a, 'http://example.org/nation/' || n_nationkey AS b FROM nation WHERE n_regionkey = 1 UNION SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/region/1' FROM nation WHERE n_regionkey = 1")
def q76_paths_from_bound_ends(spark, sf_dir):
    """``*`` from values another pattern binds, ``+`` to a constant."""
    body = "{ ?a ex:n_regionkey+ <http://example.org/region/1> . ?a ex:n_regionkey* ?b }"
    return RuleEngine(PREFIX).select(body, tables_graph(spark, sf_dir, "nation", "region"), a="a", b="b")
