"""Rule programs over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import queries_surface
from .engine import RuleEngine, relation
from .graph import Graph
from .sources import tables_graph

NS = "http://example.org/"
PREFIX = f"PREFIX ex: <{NS}>\n"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


@dataclass
class _Pairs:
    """A program whose result is one derived predicate's pairs."""

    tables: tuple[str, ...]
    rules: str
    predicate: str
    s: str
    o: str
    names: tuple[str, str]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables_graph(spark, sf_dir, *self.tables)
        out = RuleEngine(PREFIX + self.rules).evaluate(graph, inplace=False)
        return relation(out, NS + self.predicate, self.s, self.o, self.names)


@dataclass
class _Solve:
    """A body's solutions; ``rules`` run before."""

    tables: tuple[str, ...]
    body: str
    columns: dict[str, str]
    rules: str = ""

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables_graph(spark, sf_dir, *self.tables)
        engine = RuleEngine(PREFIX + self.rules)
        if self.rules:
            graph = engine.evaluate(graph, inplace=False)
        return engine.select(self.body, graph, **self.columns)


def pairs(name: str, tables: str, rules: str, predicate: str, names: tuple[str, str], sql: str, s: str = "bigint", o: str = "") -> None:
    QUERIES[name], ORACLE_SQL[name] = _Pairs(tuple(tables.split()), rules, predicate, s, o, names), sql


def solve(name: str, tables: str, body: str, columns: dict[str, str], sql: str | None, rules: str = "") -> None:
    QUERIES[name] = _Solve(tuple(tables.split()), body, columns, rules)
    if sql:
        ORACLE_SQL[name] = sql


# joins, filters, assignments

pairs(
    "q01_customer_region", "customer nation region",
    "RULE { ?c ex:inRegion ?name } WHERE { ?c ex:c_nationkey ?n . ?n ex:n_regionkey ?r . ?r ex:r_name ?name }",
    "inRegion", ("c_custkey", "r_name"),
    "SELECT DISTINCT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
pairs(
    "q02_filter_price", "orders",
    "IF { ?o ex:o_totalprice ?p . FILTER(?p >= 300000) } THEN { ?o ex:large ?p }",
    "large", ("o_orderkey", "o_totalprice"),
    "SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000", o="double",
)
pairs(
    "q03_theta_same_nation", "supplier",
    "?a ex:besides ?b :- ?a ex:s_nationkey ?n , ?b ex:s_nationkey ?n , FILTER(?a != ?b) .",
    "besides", ("a", "b"),
    "SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey", o="bigint",
)
pairs(
    "q04_bind_concat", "customer",
    'RULE { ?c ex:label ?l } WHERE { ?c ex:c_name ?n ; ex:c_mktsegment ?m . BIND(CONCAT(?n, " ", ?m) AS ?l) }',
    "label", ("c_custkey", "label"),
    "SELECT DISTINCT c_custkey, c_name || ' ' || c_mktsegment AS label FROM customer",
)
solve(
    "q05_arithmetic", "lineitem",
    "{ ?l ex:l_orderkey ?o ; ex:l_linenumber ?k ; ex:l_extendedprice ?p ; ex:l_discount ?d . BIND(?p * (1 - ?d) AS ?net) }",
    {"l_orderkey": "o:bigint", "l_linenumber": "k:bigint", "net": "net:double"},
    "SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
)
pairs(
    "q06_not_basic", "customer orders",
    'RULE { ?c ex:calm ?n } WHERE { ?c ex:c_name ?n . NOT { ?o ex:o_custkey ?c . ?o ex:o_orderpriority "1-URGENT" } }',
    "calm", ("c_custkey", "c_name"),
    "SELECT DISTINCT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
pairs(
    "q07_not_correlated", "supplier",
    "RULE { ?s ex:richest ?a } WHERE { ?s ex:s_nationkey ?n ; ex:s_acctbal ?a . NOT { ?t ex:s_nationkey ?n ; ex:s_acctbal ?b . FILTER(?b > ?a) } }",
    "richest", ("s_suppkey", "s_acctbal"),
    "SELECT DISTINCT s_suppkey, s_acctbal FROM supplier x WHERE NOT EXISTS (SELECT 1 FROM supplier y WHERE y.s_nationkey = x.s_nationkey AND y.s_acctbal > x.s_acctbal)", o="double",
)
pairs(
    "q08_exists", "customer orders",
    'RULE { ?c ex:urgent ?n } WHERE { ?c ex:c_name ?n . FILTER EXISTS { ?o ex:o_custkey ?c ; ex:o_orderpriority "1-URGENT" } }'.replace("FILTER EXISTS", "FILTER(EXISTS").replace('"1-URGENT" }', '"1-URGENT" })'),
    "urgent", ("c_custkey", "c_name"),
    "SELECT DISTINCT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
pairs(
    "q09_not_exists", "part lineitem",
    "RULE { ?p ex:idle ?n } WHERE { ?p ex:p_name ?n . FILTER(NOT EXISTS { ?l ex:l_partkey ?p ; ex:l_discount ?d . FILTER(?d > 0.09) }) }",
    "idle", ("p_partkey", "p_name"),
    "SELECT DISTINCT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)",
)
pairs(
    "q10_exists_filter", "customer orders",
    "RULE { ?c ex:splurged ?a } WHERE { ?c ex:c_acctbal ?a . FILTER(EXISTS { ?o ex:o_custkey ?c ; ex:o_totalprice ?t . FILTER(?t > 30 * ?a) } && ?a > 100) }",
    "splurged", ("c_custkey", "c_acctbal"),
    "SELECT DISTINCT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 30 * c_acctbal)", o="double",
)
pairs(
    "q10b_exists_in_or", "customer orders",
    'RULE { ?c ex:either ?a } WHERE { ?c ex:c_acctbal ?a . FILTER(?a < 0 || EXISTS { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" }) }',
    "either", ("c_custkey", "c_acctbal"),
    "SELECT DISTINCT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", o="double",
)
pairs(
    "q11_in", "events",
    'RULE { ?e ex:chosen ?t } WHERE { ?e ex:event_type ?t . FILTER(?t IN ("click", "purchase")) }',
    "chosen", ("event_id", "event_type"),
    "SELECT DISTINCT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
)
pairs(
    "q12_not_in", "events",
    'RULE { ?e ex:other ?t } WHERE { ?e ex:event_type ?t . FILTER(?t NOT IN ("click", "purchase")) }',
    "other", ("event_id", "event_type"),
    "SELECT DISTINCT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'purchase')",
)
solve(
    "q12b_cross_join", "region nation",
    "{ ?r ex:r_name ?a . ?n ex:n_name ?b . FILTER(STRLEN(?a) < STRLEN(?b) + 2) }",
    {"r_name": "a", "n_name": "b"},
    "SELECT DISTINCT r_name, n_name FROM region, nation WHERE length(r_name) < length(n_name) + 2",
)

# paths

pairs(
    "q13_path_seq", "orders customer nation",
    "RULE { ?o ex:from ?n } WHERE { ?o ex:o_custkey/ex:c_nationkey/ex:n_name ?n }",
    "from", ("o_orderkey", "n_name"),
    "SELECT DISTINCT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
pairs(
    "q14_path_inverse", "nation customer",
    "RULE { ?n ex:home ?c } WHERE { ?n ^ex:c_nationkey ?c }",
    "home", ("n_nationkey", "c_custkey"),
    "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS n_nationkey, c_custkey FROM customer", o="bigint",
)
pairs(
    "q15_path_alt", "nation customer supplier",
    "RULE { ?n ex:houses ?x } WHERE { ?n ^(ex:c_nationkey|ex:s_nationkey)/(ex:c_name|ex:s_name) ?x }",
    "houses", ("n_nationkey", "name"),
    "SELECT CAST(c_nationkey AS BIGINT) AS n_nationkey, c_name AS name FROM customer UNION SELECT CAST(s_nationkey AS BIGINT), s_name FROM supplier",
)
_NEXT = "RULE { ?a ex:next ?b } WHERE { ?x ex:conv_id ?c ; ex:turn ?s . ?y ex:conv_id ?c ; ex:turn ?t . FILTER(?t = ?s + 1) BIND(?x AS ?a) BIND(?y AS ?b) }\n"
_TURNS = "SELECT DISTINCT x.conv_id || '/' || x.turn AS a, y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn {} x.turn"
_TURN_NODES = "SELECT conv_id || '/' || turn AS a, conv_id || '/' || turn AS b FROM conversations"
solve("q16_path_plus", "conversations", "{ ?a ex:next+ ?b }", {"a": "a:string", "b": "b:string"}, _TURNS.format(">"), _NEXT)
solve(
    "q17_path_star", "conversations", "{ ?a ex:role ?r . ?a ex:next* ?b . FILTER(?r = \"user\") }", {"a": "a", "b": "b"},
    "SELECT DISTINCT 'http://example.org/conversations/' || x.conv_id || '/' || x.turn AS a, 'http://example.org/conversations/' || y.conv_id || '/' || y.turn AS b "
    "FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn >= x.turn WHERE x.role = 'user'", _NEXT,
)
solve(
    "q18_path_optional", "conversations", "{ ?a ex:role ?r . ?a ex:next? ?b }", {"a": "a", "b": "b"},
    "SELECT DISTINCT 'http://example.org/conversations/' || x.conv_id || '/' || x.turn AS a, 'http://example.org/conversations/' || y.conv_id || '/' || y.turn AS b "
    "FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn IN (x.turn, x.turn + 1)", _NEXT,
)
solve(
    "q19_path_negated", "region", "{ ?a !(rdf:type|ex:r_regionkey) ?b }", {"a": "a", "b": "b"},
    "SELECT DISTINCT 'http://example.org/region/' || r_regionkey AS a, r_name AS b FROM region",
)

# recursion and declarations

pairs("q20_transitive_closure", "conversations", _NEXT + "RULE { ?a ex:later ?b } WHERE { ?a ex:next ?b }\nRULE { ?a ex:later ?c } WHERE { ?a ex:next ?b . ?b ex:later ?c }", "later", ("a", "b"), _TURNS.format(">"), s="string", o="string")
pairs("q21_transitive", "conversations", _NEXT + "TRANSITIVE(ex:next)", "next", ("a", "b"), _TURNS.format(">"), s="string", o="string")
pairs(
    "q22_symmetric", "customer nation",
    "SYMMETRIC(ex:peer)\nRULE { ?a ex:peer ?b } WHERE { ?a ex:n_regionkey ?r . ?b ex:n_regionkey ?r . ?a ex:n_nationkey ?x . ?b ex:n_nationkey ?y . FILTER(?x < ?y) }",
    "peer", ("a", "b"),
    "SELECT DISTINCT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey", o="bigint",
)
pairs(
    "q23_inverse", "orders", "INVERSE(ex:o_custkey, ex:placed)", "placed", ("c_custkey", "o_orderkey"),
    "SELECT DISTINCT o_custkey AS c_custkey, o_orderkey FROM orders", o="bigint",
)
pairs(
    "q24_reflexive", "nation", "REFLEXIVE(ex:n_regionkey)", "n_regionkey", ("a", "b"),
    "SELECT 'http://example.org/nation/' || n_nationkey AS a, 'http://example.org/region/' || n_regionkey AS b FROM nation UNION "
    "SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/nation/' || n_nationkey FROM nation UNION "
    "SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/region/' || n_regionkey FROM nation", s="", o="",
)
pairs(
    "q25_union_heads", "customer supplier",
    "RULE { ?n ex:resident ?x } WHERE { ?c ex:c_nationkey ?n ; ex:c_name ?x }\nRULE { ?n ex:resident ?x } WHERE { ?s ex:s_nationkey ?n ; ex:s_name ?x }",
    "resident", ("n_nationkey", "name"),
    "SELECT CAST(c_nationkey AS BIGINT) AS n_nationkey, c_name AS name FROM customer UNION SELECT CAST(s_nationkey AS BIGINT), s_name FROM supplier",
)
pairs(
    "q26_strata_chain", "customer orders",
    "RULE { ?c ex:loyal ?s } WHERE { ?c ex:quiet ?s }\n"
    "RULE { ?c ex:quiet ?s } WHERE { ?c ex:c_mktsegment ?s . NOT { ?c ex:busy true } }\n"
    "RULE { ?c ex:busy true } WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?p . FILTER(?p > 200000) }",
    "loyal", ("c_custkey", "c_mktsegment"),
    "SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
)
pairs(
    "q27_self_negation_default", "customer",
    'RULE { ?c ex:rank "gold" } WHERE { ?c ex:c_acctbal ?a . FILTER(?a > 9000) }\nRULE { ?c ex:rank "plain" } WHERE { ?c ex:c_name ?n . NOT { ?c ex:rank ?any } }',
    "rank", ("c_custkey", "rank"),
    "SELECT DISTINCT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'gold' ELSE 'plain' END AS rank FROM customer",
)
solve(
    "q28_multi_head", "orders", "{ ?x ex:bought ?o . ?o ex:buyer ?x }", {"c_custkey": "x:bigint", "o_orderkey": "o:bigint"},
    "SELECT DISTINCT o_custkey AS c_custkey, o_orderkey FROM orders",
    "RULE { ?c ex:bought ?o . ?o ex:buyer ?c } WHERE { ?o ex:o_custkey ?c }",
)
solve(
    "q29_variable_predicate", "nation", "{ ?s ?p ?o . FILTER(CONTAINS(STR(?p), \"n_\")) }", {"s": "s", "p": "p", "o": "o"},
    "SELECT s, p, o FROM (SELECT 'http://example.org/nation/' || n_nationkey AS s, 'http://example.org/n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM nation UNION "
    "SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/n_name', n_name FROM nation UNION "
    "SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/n_regionkey', 'http://example.org/region/' || n_regionkey FROM nation)",
)
solve(
    "q30_repeated_variable", "nation", "{ ?x ex:peer ?x }", {"x": "x:bigint"},
    "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS x FROM nation",
    "RULE { ?a ex:peer ?b } WHERE { ?a ex:n_regionkey ?r . ?b ex:n_regionkey ?r }",
)
solve(
    "q30b_star_join", "lineitem",
    '{ ?l ex:l_orderkey ?o ; ex:l_partkey ?p ; ex:l_quantity ?q ; ex:l_returnflag "R" ; ex:l_shipdate ?d . FILTER(?q > 45 && YEAR(?d) = 1995) }',
    {"l_orderkey": "o:bigint", "l_partkey": "p:bigint", "l_quantity": "q:double"},
    "SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND year(l_shipdate) = 1995",
)
solve(
    "q30c_four_way", "lineitem orders customer nation",
    "{ ?l ex:l_orderkey ?o ; ex:l_discount ?d . ?o ex:o_custkey ?c ; ex:o_orderpriority ?pr . ?c ex:c_nationkey ?n . ?n ex:n_name ?name . FILTER(?d >= 0.1) }",
    {"o_orderkey": "o:bigint", "o_orderpriority": "pr", "n_name": "name"},
    "SELECT DISTINCT o_orderkey, o_orderpriority, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_discount >= 0.1",
)


# functions: one query a group, over a table whose key is ?k


def functions(name: str, table: str, key: str, columns: str, sql_from: str, **exprs: tuple[str, str, str]) -> None:
    """exprs: column = (rule expression, result's Spark type, SQL expression). columns: "?v column ..."."""
    words = columns.split()
    body = f"{{ ?k {' ; '.join(f'ex:{c} {v}' for v, c in zip(words[::2], words[1::2]))} . "
    body += " ".join(f"BIND({e} AS ?r_{c})" for c, (e, _, _) in exprs.items()) + " }"
    out = {key: "k:bigint"} | {c: f"r_{c}:{t}" if t else f"r_{c}" for c, (_, t, _) in exprs.items()}
    sql = f"SELECT DISTINCT CAST({key} AS BIGINT) AS {key}, " + ", ".join(f"{s} AS {c}" for c, (_, _, s) in exprs.items()) + f" FROM {sql_from}"
    solve(name, table, body, out, None if any(not s for _, _, s in exprs.values()) else sql)


functions(
    "q31_strlen_substr", "customer", "c_custkey", "?n c_name", "customer",
    len=("STRLEN(?n)", "bigint", "CAST(length(c_name) AS BIGINT)"), tail=("SUBSTR(?n, 10)", "", "substr(c_name, 10)"), mid=("SUBSTR(?n, 3, 4)", "", "substr(c_name, 3, 4)"),
)
functions(
    "q32_case", "part", "p_partkey", "?n p_name ?t p_type", "part",
    up=("UCASE(?n)", "", "upper(p_name)"), low=("LCASE(?t)", "", "lower(p_type)"),
)
functions(
    "q33_string_tests", "part", "p_partkey", "?n p_name ?t p_type", "part",
    starts=('STRSTARTS(?t, "PROMO")', "boolean", "starts_with(p_type, 'PROMO')"), ends=('STRENDS(?n, "e")', "boolean", "ends_with(p_name, 'e')"), has=('CONTAINS(?n, "a")', "boolean", "contains(p_name, 'a')"),
)
functions(
    "q34_before_after", "pages", "page_id", "?u url", "pages",
    scheme=('STRBEFORE(?u, "://")', "", "CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') - 1) ELSE '' END"),
    rest=('STRAFTER(?u, "://")', "", "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"),
    none=('STRAFTER(?u, "@@")', "", "''"),
)
functions(
    "q35_replace", "pages", "page_id", "?u url", "pages",
    out=(r'REPLACE(?u, "([0-9]+)", "<\\1>")', "", r"regexp_replace(url, '([0-9]+)', '<\1>', 'g')"),
    flat=('REPLACE(?u, "EXAMPLE", "$", "i")', "", "regexp_replace(url, 'EXAMPLE', '$', 'gi')"),
)
functions(
    "q36_regex", "pages", "page_id", "?u url", "pages",
    digits=(r'REGEX(?u, "[0-9]{3}")', "boolean", "regexp_matches(url, '[0-9]{3}')"), any=('REGEX(?u, "^HTTPS:", "i")', "boolean", "regexp_matches(url, '^HTTPS:', 'i')"),
)
functions("q37_encode_for_uri", "pages", "page_id", "?u url", "pages", enc=("ENCODE_FOR_URI(?u)", "", "url_encode(url)"))
functions(
    "q38_hashes", "customer", "c_custkey", "?n c_name", "customer",
    m=("MD5(?n)", "", "md5(c_name)"), s1=("SHA1(?n)", "", "sha1(c_name)"), s256=("SHA256(?n)", "", "sha256(c_name)"),
)
functions(
    "q39_numeric", "customer", "c_custkey", "?a c_acctbal", "customer",
    abs=("ABS(?a)", "double", "abs(c_acctbal)"), round=("ROUND(?a)", "bigint", "CAST(round_even(c_acctbal, 0) AS BIGINT)"),
    ceil=("CEIL(?a)", "bigint", "CAST(ceil(c_acctbal) AS BIGINT)"), floor=("FLOOR(?a)", "bigint", "CAST(floor(c_acctbal) AS BIGINT)"),
)
functions(
    "q40_conditions", "customer", "c_custkey", "?a c_acctbal ?n c_name", "customer",
    rich=('IF(?a > 5000, "rich", "poor")', "", "CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END"),
    first=("COALESCE(?missing, 1 / 0, ?n)", "", "c_name"), bound=("BOUND(?n)", "boolean", "true"), free=("BOUND(?missing)", "boolean", "false"),
)
functions(
    "q41_term_parts", "documents", "doc_id", "?l lang ?n n_chars", "documents",
    str=("STR(?k)", "", "'http://example.org/documents/' || doc_id"), dt=("STR(DATATYPE(?n))", "", "'http://www.w3.org/2001/XMLSchema#integer'"),
    tag=('LANG(STRLANG("x", ?l))', "", "lang"), en=('LANGMATCHES(LANG(STRLANG("x", ?l)), "en")', "boolean", "lang = 'en'"),
    typed=('STR(DATATYPE(STRDT("5", <http://www.w3.org/2001/XMLSchema#byte>)))', "", "'http://www.w3.org/2001/XMLSchema#byte'"),
)
functions(
    "q42_same_term", "customer", "c_custkey", "?n c_name ?c c_custkey", "customer",
    same=("SAMETERM(?n, ?n)", "boolean", "true"), value=("?c = ?c + 0.0", "boolean", "true"), term=("SAMETERM(?c, ?c + 0.0)", "boolean", "false"),
)
functions(
    "q43_kinds", "customer", "c_custkey", "?n c_name ?a c_acctbal ?h c_nationkey", "customer",
    iri=("ISIRI(?h)", "boolean", "true"), lit=("ISLITERAL(?n)", "boolean", "true"), num=("ISNUMERIC(?a)", "boolean", "true"),
    notnum=("ISNUMERIC(?n)", "boolean", "false"), blank=("ISBLANK(?k)", "boolean", "false"), made=('ISIRI(IRI("http://x/"))', "boolean", "true"),
)
functions(
    "q44_dates", "orders", "o_orderkey", "?d o_orderdate", "orders",
    y=("YEAR(?d)", "bigint", "year(o_orderdate)"), m=("MONTH(?d)", "bigint", "month(o_orderdate)"), d=("DAY(?d)", "bigint", "day(o_orderdate)"),
)
functions(
    "q45_times", "events", "event_id", "?t ts", "events",
    h=("HOURS(?t)", "bigint", "hour(ts)"), mi=("MINUTES(?t)", "bigint", "minute(ts)"), s=("SECONDS(?t)", "double", "CAST(second(ts) AS DOUBLE)"),
)
functions(
    "q46_literal_dates", "region", "r_regionkey", "?n r_name", "region",
    y=('YEAR("2024-05-06T07:08:09.5+02:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>)', "bigint", "CAST(2024 AS BIGINT)"),
    z=('STR(TIMEZONE("2024-05-06T07:08:09-05:30"^^<http://www.w3.org/2001/XMLSchema#dateTime>))', "", "'-PT5H30M'"),
    tz=('TZ("2024-05-06T07:08:09Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>)', "", "'Z'"),
)
functions(
    "q47_logic", "customer", "c_custkey", "?a c_acctbal ?k2 c_custkey", "customer",
    either=("?a > 9000 || ?nothing", "boolean", "c_acctbal > 9000"), both=("?a > 0 && ?k2 > 100", "boolean", "c_acctbal > 0 AND c_custkey > 100"),
    neither=("!(?a > 0)", "boolean", "NOT c_acctbal > 0"), minus=("-?k2", "bigint", "-c_custkey"), half=("?k2 / 2", "double", "c_custkey / 2"),
)
functions(
    "q48_compare", "part", "p_partkey", "?s p_size ?n p_name", "part",
    lt=("?s < 10", "boolean", "p_size < 10"), le=("?s <= 10", "boolean", "p_size <= 10"), ne=("?s != 10", "boolean", "p_size <> 10"),
    eqs=('?n = "none"', "boolean", "p_name = 'none'"), text=('?n > "m"', "boolean", "p_name > 'm'"),
)
functions(
    "q49_custom_casts", "part", "p_partkey", "?s p_size", "part",
    i=('<http://www.w3.org/2001/XMLSchema#integer>("12") + ?s', "bigint", "CAST(12 + p_size AS BIGINT)"), t=("<http://www.w3.org/2001/XMLSchema#string>(?s)", "", "CAST(p_size AS VARCHAR)"),
)
# the engine's own surface

pairs(
    "q51_data_block", "nation",
    'DATA { <http://example.org/region/0> ex:tag "zero" . <http://example.org/region/1> ex:tag "one" }\nRULE { ?n ex:tagged ?t } WHERE { ?n ex:n_regionkey ?r . ?r ex:tag ?t }',
    "tagged", ("n_nationkey", "tag"),
    "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'one' END AS tag FROM nation WHERE n_regionkey IN (0, 1)",
)


def q52_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples each rule of each stratum was first to derive."""
    from pyspark.sql import functions as F

    rules = PREFIX + (
        "RULE { ?n ex:named ?x } WHERE { ?n ex:n_name ?x }\nRULE { ?r ex:named ?x } WHERE { ?r ex:r_name ?x }\n"
        "RULE { ?r ex:bare true } WHERE { ?r ex:r_name ?x . NOT { ?n ex:n_regionkey ?r . ?n ex:named ?y . FILTER(STRSTARTS(?y, \"A\")) } }"
    )
    _, log = RuleEngine(rules).evaluate_with_provenance(tables_graph(spark, sf_dir, "nation", "region"), inplace=False)
    return log.groupBy("rule", "stratum").agg(F.count("*").alias("n"))


QUERIES["q52_provenance"] = q52_provenance
ORACLE_SQL["q52_provenance"] = (
    "SELECT * FROM (SELECT 0 AS rule, 0 AS stratum, count(DISTINCT (n_nationkey, n_name)) AS n FROM nation UNION ALL "
    "SELECT 1, 0, count(DISTINCT (r_regionkey, r_name)) FROM region UNION ALL "
    "SELECT 2, 1, count(*) FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND starts_with(n_name, 'A'))) WHERE n > 0"
)


def q53_results_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New triples only: suppliers' own nation links are there already."""
    graph = tables_graph(spark, sf_dir, "customer", "supplier")
    rules = PREFIX + "RULE { ?x ex:s_nationkey ?n } WHERE { ?x ex:c_nationkey ?n }\nRULE { ?x ex:s_nationkey ?n } WHERE { ?x ex:s_nationkey ?n }"
    new: Graph = RuleEngine(rules).evaluate(graph, inplace=False, results_only=True)
    return relation(new, NS + "s_nationkey", "", "bigint", ("x", "n_nationkey"))


QUERIES["q53_results_only"] = q53_results_only
ORACLE_SQL["q53_results_only"] = "SELECT DISTINCT 'http://example.org/customer/' || c_custkey AS x, CAST(c_nationkey AS BIGINT) AS n_nationkey FROM customer"


QUERIES |= queries_surface.QUERIES
ORACLE_SQL |= queries_surface.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q01_customer_region"](spark, sf_dir)
