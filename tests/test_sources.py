import pytest
from pyspark.sql import functions as F

from lodestone.cli import main
from lodestone.engine import RuleEngine
from lodestone.graph import Graph
from lodestone.model import IRI, XSD, Blank, Literal, Triple
from lodestone.plans.stratify import StratificationError
from lodestone.sources import read_graph, tables_graph, write_graph
from lodestone.sources.turtle import parse_json_ld, parse_turtle, parse_xml
from lodestone.streaming import apply_rules

TURTLE = """@prefix : <http://t/> . @base <http://b/> .
:a :p "x\\ty \\"q\\"", 'l'@en-GB, 007, 1.50, 2e3, true, <rel> ; a :T ; .
_:n :p [ :q "multi
line" ] .
""".replace('"multi\nline"', '"""multi\nline"""')


def plain(graph):
    return {(r.s.k, r.s.v, r.p.v, r.o.k, r.o.v, r.o.dt, r.o.lang) for r in graph.triples().collect()}


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "in.ttl").write_text(TURTLE, encoding="utf-8")
    g = read_graph(spark, str(tmp_path / "in.ttl"))
    assert g.count() == 10
    for name in ("out.nt", "out.parquet", "out.ttl", "out.rdf", "out.jsonld"):
        write_graph(g, str(tmp_path / name))
        assert plain(read_graph(spark, str(tmp_path / name))) == plain(g)


def test_lines(spark, tmp_path):
    (tmp_path / "x.nt").write_text('# note\n<http://a> <http://p> "q\\u00e9\\n\\"" .\n_:b <http://p> "01"^^<http://www.w3.org/2001/XMLSchema#integer> . # end\n\n<http://a> <http://p> "h"@EN .\n', encoding="utf-8")
    assert plain(read_graph(spark, str(tmp_path / "x.nt"))) == {
        (1, "http://a", "http://p", 3, 'qé\n"', "", ""),
        (2, "b", "http://p", 3, "1", XSD + "integer", ""),
        (1, "http://a", "http://p", 3, "h", "", "en"),
    }
    (tmp_path / "y.nq").write_text("<http://a> <http://p> <http://o> <http://g> .\n")
    assert read_graph(spark, str(tmp_path / "y.nq")).count() == 1
    (tmp_path / "z.nt").write_text("nonsense\n")
    with pytest.raises(Exception, match="not a triple"):
        read_graph(spark, str(tmp_path / "z.nt")).count()


def test_other_documents():
    assert parse_turtle("@prefix : <http://t/> . :g { :a :b :c } GRAPH :h { :d :e 1 }", True) == [Triple(IRI("http://t/a"), IRI("http://t/b"), IRI("http://t/c")), Triple(IRI("http://t/d"), IRI("http://t/e"), Literal("1", XSD + "integer"))]
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://t/"><T rdf:about="http://x"><n xml:lang="en">hi</n><k rdf:resource="http://y"/><m rdf:parseType="Resource"><v rdf:datatype="http://d">1</v></m></T></rdf:RDF>'
    got = parse_xml(xml)
    assert len(got) == 5 and Triple(IRI("http://x"), IRI("http://t/n"), Literal("hi", "", "en")) in got and isinstance([t for t in got if t.predicate.value == "http://t/m"][0].object, Blank)
    js = '{"@context": {"e": "http://t/", "k": {"@id": "e:k", "@type": "@id"}}, "@id": "e:a", "@type": "e:T", "e:n": [1, true, {"@value": "x", "@language": "en"}], "k": "e:b"}'
    assert len(parse_json_ld(js)) == 5 and Triple(IRI("http://t/a"), IRI("http://t/k"), IRI("http://t/b")) in parse_json_ld(js)


def test_graph_algebra(spark):
    t = lambda *x: Triple(*[IRI("http://t/" + c) for c in x])
    a, b = Graph(spark).add_triples([t("a", "p", "b"), t("a", "p", "b"), t("c", "q", "d")]), Graph(spark).add_triples([t("a", "p", "b")])
    assert (a.count(), a.union(b).count(), a.minus(b).count()) == (2, 2, 1)
    assert a.contains(t("c", "q", "d")) and not b.contains(t("c", "q", "d"))


def test_tables_read_only_what_is_named(spark):
    g = tables_graph(spark, "/root/testdata/sf0.001", "lineitem", "orders")
    rows = RuleEngine("PREFIX ex: <http://example.org/>").solve('{ ?l ex:l_orderkey ?o ; ex:l_quantity ?q . ?o ex:o_orderstatus "F" . FILTER(?q > 40) }', g)
    plan = rows.df._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert any("o_orderstatus:string>" in x and "EqualTo(o_orderstatus,F)" in x for x in scans) and len(scans) == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_command_line(tmp_path, capsys, spark):
    (tmp_path / "r.rules").write_text("PREFIX : <http://t/>\nRULE { ?x :q ?y } WHERE { ?x :p ?y . NOT { ?x :no ?z } }", encoding="utf-8")
    (tmp_path / "d.ttl").write_text("@prefix : <http://t/> . :a :p :b .", encoding="utf-8")
    r, d, o = (str(tmp_path / n) for n in ("r.rules", "d.ttl", "o.ttl"))
    assert main(["-v", "parse", r]) == 0 and main(["analyze", r, "--show-layers"]) == 0
    assert main(["-v", "eval", r, d, "-o", o]) == 0 and main(["eval", r, d, "-o", o, "--inferred-only"]) == 0
    out = capsys.readouterr().out
    assert "1 inferred" in out and "rules: 1" in out and "1 strata" in out
    assert "q" in (tmp_path / "o.ttl").read_text() and main(["parse", str(tmp_path / "none")]) == 1 and main(["shacl", r]) == 2


def test_stream(spark, tmp_path):
    rules = RuleEngine("PREFIX : <http://t/> TRANSITIVE(:p)")
    g = Graph(spark).add_triples([Triple(IRI(f"http://t/{k}"), IRI("http://t/p"), IRI(f"http://t/{k + 1}")) for k in range(3)])
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        g.triples().where(F.col("s.v") == f"http://t/{k}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(g.triples().schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = apply_rules(rules, stream, Graph(spark), out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).select("s", "o").distinct().count() == 6
    with pytest.raises(StratificationError):
        apply_rules(RuleEngine("PREFIX : <http://t/> RULE { ?x :a 1 } WHERE { ?x :b 1 . NOT { ?x :c 1 } }"), stream, Graph(spark), out)


def test_clusters_need_a_shared_folder():
    """No machine-local folder where executors live on other machines."""
    from types import SimpleNamespace as Stub

    from lodestone.storage import shared_folder

    unset = Stub(isDefined=lambda: False)
    context = Stub(master="spark://host:7077", _jsc=Stub(sc=lambda: Stub(getCheckpointDir=lambda: unset)))
    named = {"spark.checkpoint.dir": "s3a://bucket/tmp/"}
    assert shared_folder(Stub(conf=Stub(get=lambda k, d: named.get(k, d)), sparkContext=context)) == "s3a://bucket/tmp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Stub(conf=Stub(get=lambda k, d: d), sparkContext=context))
