"""Physical plans: what reaches the source, how often a table is read, what joins are keyed by."""

import re

import pytest

from lodestone.engine import RuleEngine
from lodestone.plans.compile import Compiler
from lodestone.queries import NS, PREFIX, QUERIES
from lodestone.sources import tables_graph
from lodestone.storage import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def scans(text: str) -> list[tuple[str, set[str], str]]:
    """(file, columns, pushed filters) of each scan."""
    out = []
    for line in text.splitlines():
        if "FileScan" in line:
            file = re.search(r"/(\w+)\.parquet", line)[1]
            columns = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", line)[1]))
            out.append((file, columns, re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)[1]))
    return out


def joins(text: str) -> list[str]:
    return [line for line in text.splitlines() if "Join" in line]


@pytest.mark.parametrize(
    ("query", "filter"),
    [
        ("q02_filter_price", "GreaterThanOrEqual(o_totalprice,300000.0)"),
        ("q11_in", "In(event_type, [click,purchase])"),
        ("q12_not_in", "Not(In(event_type, [click,purchase]))"),
        ("q30b_star_join", "GreaterThan(l_quantity,45.0)"),
        ("q30b_star_join", "EqualTo(l_returnflag,R)"),
        ("q30c_four_way", "GreaterThanOrEqual(l_discount,0.1)"),
        ("q10_exists_filter", "GreaterThan(c_acctbal,100.0)"),
        ("q06_not_basic", "EqualTo(o_orderpriority,1-URGENT)"),
    ],
)
def test_filters_reach_the_source(spark, query, filter):
    assert any(filter in pushed for _, _, pushed in scans(plan(QUERIES[query](spark, SF))))


def body_plan(spark, body, *tables):
    engine = RuleEngine(PREFIX)
    return plan(engine.solve(body, tables_graph(spark, SF, *tables)).df)


@pytest.mark.parametrize("test", ["?k < 10", "?k != 10", "!(?k = 3)", "?k = 3 || ?k > 900", "?k IN (1, 2)", "3 < ?k && ?k < 9"])
def test_comparisons_of_integers(spark, test):
    text = body_plan(spark, f"{{ ?o ex:o_custkey ?c . ?c ex:c_custkey ?k . FILTER({test}) }}", "orders", "customer")
    assert any(f == "customer" and ("Than" in p or "EqualTo" in p or "In(" in p) for f, _, p in scans(text))


@pytest.mark.parametrize(
    ("query", "read"),
    [
        ("q06_not_basic", [("customer", {"c_custkey", "c_name"}), ("orders", {"o_custkey", "o_orderpriority", "o_orderkey"})]),
        ("q07_not_correlated", [("supplier", {"s_suppkey", "s_nationkey", "s_acctbal"})] * 2),
        ("q08_exists", [("customer", {"c_custkey", "c_name"}), ("orders", {"o_custkey", "o_orderpriority", "o_orderkey"})]),
        ("q09_not_exists", [("lineitem", {"l_partkey", "l_discount"}), ("part", {"p_partkey", "p_name"})]),
        ("q30b_star_join", [("lineitem", {"l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"})]),
    ],
)
def test_tables_are_read_once_and_only_what_is_named(spark, query, read):
    assert sorted((f, sorted(c)) for f, c, _ in scans(plan(QUERIES[query](spark, SF)))) == sorted((f, sorted(c)) for f, c in read)


def test_equalities_between_two_sides_are_join_keys(spark):
    body = "{ ?x ex:conv_id ?c ; ex:turn ?s . ?y ex:conv_id ?c ; ex:turn ?t . FILTER(?t = ?s + 1) }"
    (join,) = joins(body_plan(spark, body, "conversations"))
    keys = re.search(r"Join \[(.*?)\], \[(.*?)\], Inner", join)
    assert keys and "turn" not in join.split("Inner")[1] and len(re.findall(r"#\d+", keys[1])) >= 2
    assert "CartesianProduct" not in join and "NestedLoop" not in join


def test_no_shuffle_where_rows_are_a_set_already(spark):
    for query in ("q02_filter_price", "q04_bind_concat", "q11_in"):
        text = plan(QUERIES[query](spark, SF))
        assert "HashAggregate" not in text, query


def test_a_constant_end_is_searched_from_there(spark, monkeypatch):
    """No closure of the whole relation, no list of all nodes."""
    from lodestone.plans import compile as compiled

    def never(*args):
        raise AssertionError("not needed for a bound end")

    monkeypatch.setattr(compiled, "closure", never)
    graph = tables_graph(spark, SF, "nation", "customer")
    monkeypatch.setattr(type(graph), "nodes", never)
    engine = RuleEngine(PREFIX)
    up = engine.select(f"{{ <{NS}customer/1> ex:c_nationkey ?n }}", graph, n="n:bigint").collect()
    for path, ends in (("(ex:c_nationkey|ex:n_regionkey)+", 2), ("(ex:c_nationkey|ex:n_regionkey)*", 3), ("ex:c_nationkey?", 2)):
        got = engine.select(f"{{ <{NS}customer/1> {path} ?e }}", graph, e="e").collect()
        assert len(got) == ends and f"{NS}nation/{up[0].n}" in {r.e for r in got}
    back = engine.select(f"{{ ?c (ex:c_nationkey|ex:n_regionkey)+ <{NS}region/1> }}", tables_graph(spark, SF, "nation", "customer"), c="c").count()
    nations = engine.select(f"{{ ?n ex:n_regionkey <{NS}region/1> }}", graph, n="n:bigint").count()
    assert back >= nations > 0


def test_star_paths_start_at_bound_values(spark, monkeypatch):
    graph = tables_graph(spark, SF, "nation", "region")
    monkeypatch.setattr(type(graph), "nodes", lambda self: (_ for _ in ()).throw(AssertionError("all nodes")))
    rows = RuleEngine(PREFIX).select("{ ?n ex:n_name ?x . ?n ex:n_regionkey* ?e }", graph, n="n", e="e")
    assert rows.count() == 50


def test_rows_of_the_compiler_know_their_key(spark):
    graph = tables_graph(spark, SF, "nation", "lineitem")
    compiler = Compiler(spark, graph, Scratch(spark))
    from lodestone.parser import parse_body

    prefixes = {"ex": NS}
    assert compiler.body(parse_body("{ ?n ex:n_name ?x ; ex:n_regionkey ?r }", prefixes)).key == {"n"}
    assert compiler.body(parse_body("{ ?l ex:l_tax ?x ; ex:l_discount ?r }", prefixes)).key is None


def test_annotations_do_not_meet_each_with_each(spark):
    """All of a rule's annotations have one reifier: what they say is joined by value as well, whatever the patterns' order."""
    rules = "RULE { ?c ex:owes ?a {| ex:about ?n |} } WHERE { ?c ex:c_acctbal ?a ; ex:c_name ?n . FILTER(?a < 0) }"
    parts = ["?c ex:owes ?a", "?st rdf:reifies <<( ?c ex:owes ?a )>>", "?st ex:about ?x", "?c ex:c_name ?x"]
    engine = RuleEngine(PREFIX + rules)
    graph = engine.evaluate(tables_graph(spark, SF, "customer"), inplace=False)
    for order in (parts, parts[::-1], [parts[k] for k in (2, 1, 0, 3)]):
        text = plan(engine.select("{ " + " . ".join(order) + " }", graph, c="c", about="x"))
        assert len(joins(text)) == 3 and not re.search("Cartesian|NestedLoop", text)
