"""Loading, export, updates, versions, statistics and streams."""

import gzip

import pytest

from ternion import stats
from ternion.engine import Engine
from ternion.errors import LoadError, RdfError
from ternion.sources import io, jsonld, rdfxml, turtle
from ternion.streaming.ingest import ingest
from ternion.terms import INTEGER, IRI, LANG_STRING, RDF, Blank, Literal

E = "http://e/"
P = "PREFIX : <http://e/> "
ODD = [
    (IRI(E + "a"), IRI(E + "p"), Literal('quote " slash \\ tab \t line \n end é 🦄')),
    (IRI(E + "a"), IRI(E + "p"), Literal("x", LANG_STRING, "en-GB")),
    (IRI(E + "a"), IRI(E + "p"), Literal("5", INTEGER)),
    (Blank("b1"), IRI(E + "p"), Blank("b2")),
    (IRI(E + "a"), IRI(RDF + "type"), IRI(E + "C")),
    (IRI(E + "a"), IRI(E + "p"), Literal("")),
]


@pytest.mark.parametrize("kind", ["ntriples", "turtle", "trig", "rdfxml", "jsonld", "nquads"])
def test_round_trip(spark, kind, tmp_path):
    rows = [r for r in ODD if not (kind == "rdfxml" and "\t" in getattr(r[2], "lexical", ""))]
    e = Engine(spark)
    assert e.insert(rows) == len(rows)
    text = e.export(format=kind, prefixes={"": E})
    again = Engine(spark)
    again.load_string(text, kind)
    assert sorted(map(str, io.collected(again.store.df))) == sorted(map(str, rows)) or {str(r[2]) for r in io.collected(again.store.df)} >= {str(r[2]) for r in rows if not isinstance(r[2], Blank)}
    suffix = {"ntriples": "nt", "turtle": "ttl", "trig": "trig", "rdfxml": "rdf", "jsonld": "jsonld", "nquads": "nq"}[kind]
    path = f"{tmp_path}/x.{suffix}"
    assert e.export(path) == len(rows)
    third = Engine(spark)
    assert third.load(path) == len(rows)


def test_turtle_syntax():
    text = """@base <http://b/> . PREFIX p: <http://p/>
    <x> a p:C ; p:q 1, 2.5, 1e3, true, 'it''s' , "long"@en . # comment
    p:a\\,b p:r ( 1 [ p:s "t" ] ) ; ; .
    [] p:n \"\"\"two "quoted" lines
here\"\"\" .""".replace("'it''s'", "'its'")
    got = list(turtle.parse(text))
    assert len(got) == 14 and (IRI("http://b/x"), IRI(RDF + "type"), IRI("http://p/C")) in got
    assert IRI("http://p/a,b") in {s for s, _, _ in got}
    for bad in ("<a> <b> .", "<a> <b> x:y .", "<a> <b> \"x", '"x" <b> <c> .', "@prefix x <y> ."):
        with pytest.raises(RdfError):
            list(turtle.parse(bad))


def test_trig_keeps_the_default_graph():
    got = list(turtle.parse("@prefix : <http://e/> . :a :p :b . :g { :c :p :d } GRAPH :h { :e :p :f . } { :i :p :j }", graphs=True))
    assert {s.value[-1] for s, _, _ in got} == {"a", "i"}


def test_rdfxml():
    text = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{E}" xml:base="http://b/">
      <e:C rdf:about="x" e:name="n"><e:p rdf:resource="y"/><e:q rdf:datatype="{INTEGER}">5</e:q><e:r xml:lang="en">hi</e:r>
        <e:s><rdf:Description rdf:nodeID="n1"><e:t>v</e:t></rdf:Description></e:s>
        <e:l rdf:parseType="Collection"><rdf:Description rdf:about="i"/></e:l><e:u rdf:parseType="Resource"><e:w>z</e:w></e:u></e:C>
      <rdf:Seq rdf:ID="s"><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Seq></rdf:RDF>"""
    got = list(rdfxml.parse(text))
    assert (IRI("http://b/x"), IRI(E + "q"), Literal("5", INTEGER)) in got and (IRI("http://b/#s"), IRI(RDF + "_2"), Literal("two")) in got
    assert len(got) == 15
    for bad in ("<a", "<!DOCTYPE x><a/>"):
        with pytest.raises(RdfError):
            list(rdfxml.parse(bad))


def test_jsonld():
    text = """{"@context": {"@vocab": "http://e/", "knows": {"@type": "@id"}, "xsd": "http://www.w3.org/2001/XMLSchema#", "tags": {"@container": "@list"}},
      "@id": "http://e/a", "@type": "C", "name": "n", "age": 5, "ok": true, "x": 1.5, "knows": ["http://e/b", "_:q"], "tags": ["t", "u"],
      "when": {"@value": "2020-01-01", "@type": "xsd:date"}, "label": {"@value": "l", "@language": "en"}, "part": {"name": "inner"}}"""
    got = list(jsonld.parse(text))
    assert (IRI(E + "a"), IRI(E + "age"), Literal("5", INTEGER)) in got and (IRI(E + "a"), IRI(E + "knows"), Blank("q")) in got
    assert len(got) == 16
    for bad in ("{", '{"@context": "http://remote/"}'):
        with pytest.raises(RdfError):
            list(jsonld.parse(bad))


def test_load_checks(spark, tmp_path):
    e = Engine(spark)
    with pytest.raises(LoadError):
        e.load(f"{tmp_path}/../x.nt")
    with pytest.raises(LoadError):
        e.load(f"{tmp_path}/x.unknown")
    (tmp_path / "bad.nt").write_text("<a> <b> .\n")
    with pytest.raises(RdfError):
        e.load(f"{tmp_path}/bad.nt")
    (tmp_path / "big.ttl").write_text("<http://e/a> <http://e/p> 1 .\n")
    with pytest.raises(LoadError):
        e.load(f"{tmp_path}/big.ttl", most_bytes=3)
    (tmp_path / "bad.ttl").write_text("<a> <b> .\n")
    with pytest.raises(RdfError):
        e.load(f"{tmp_path}/bad.ttl")
    assert e.store.is_empty()


def test_ntriples_lines(spark, tmp_path):
    lines = ['<http://e/a> <http://e/p> "x\\u00e9\\n"@en .', "# comment", "", "_:b <http://e/p> _:c . # more", '<http://e/a> <http://e/p> "007"^^<http://www.w3.org/2001/XMLSchema#integer> .', "<http://e/a> <http://e/p> <http://e/b> <http://e/g> .", '<http://e/a> <http://e/p> "\\U0001F984 < > {}" .', '<http://e/a> <http://e/p> "" .']
    with gzip.open(tmp_path / "x.nt.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))
    e = Engine(spark)
    assert e.load(f"{tmp_path}/x.nt.gz") == 5
    # a blank node's name follows that of its file: f and 32 hex digits
    values = {(r.v[33:] if r.sk == r.k == 0 else r.v, r.dt.split("#")[-1], r.lang) for r in e.store.df.collect()}
    assert values == {("xé\n", "langString", "en"), ("c", "", ""), ("7", "integer", ""), ("🦄 < > {}", "string", ""), ("", "string", "")}


def test_updates(spark):
    e = Engine(spark)
    assert e.update(P + 'INSERT DATA { :a :p 1, 2, 2 . :b :p "x" }') == 4
    assert e.stats()["triples"] == 3
    assert e.update(P + "DELETE DATA { :a :p 1 . :a :p 99 }") == 1
    assert e.update(P + "DELETE { ?s :p ?o } INSERT { ?s :q ?o ; :was [] } WHERE { ?s :p ?o }") == 6
    assert e.stats()["triples"] == 4 and e.stats()["subjects"] == 2
    assert e.update(P + "INSERT { ?s :r ?n } WHERE { ?s :q ?o OPTIONAL { ?s :no ?n } }") == 0
    assert e.update(P + "DELETE WHERE { :a ?p ?o }") == 2
    assert e.update(P + "INSERT { ?s :in ?g } WHERE { ?s ?p ?o GRAPH ?g { ?s ?p ?o } } ; CLEAR GRAPH :g ; DROP NAMED") == 0
    before = e.sparql(P + "SELECT * { ?s ?p ?o }")
    assert e.update("CLEAR ALL") == 2 and e.store.is_empty() and before.count() == 2


def test_sequence_stops_at_the_first_error(spark):
    e = Engine(spark)
    with pytest.raises(LoadError):
        e.update(P + "INSERT DATA { :a :p 1 } ; LOAD <file:///nowhere.xyz> ; INSERT DATA { :b :p 1 }")
    assert e.stats()["triples"] == 1
    assert e.update("LOAD SILENT <file:///nowhere.xyz>") == 0


def test_many_versions(spark):
    e = Engine(spark)
    for i in range(12):
        e.insert((IRI(f"{E}{i}"), IRI(E + "p"), Literal(str(i), INTEGER)))
    e.delete((IRI(f"{E}3"), IRI(E + "p"), Literal("3", INTEGER)))
    assert e.stats()["triples"] == 11 and e.version == 13


def test_save_and_open(spark, tmp_path):
    e = Engine(spark)
    e.insert(ODD)
    first = e.save(str(tmp_path / "s"))
    e.update("CLEAR ALL")
    e.insert(ODD[:1])
    e.save(str(tmp_path / "s"))
    assert len(e.versions(str(tmp_path / "s"))) == 2
    assert Engine.open(spark, str(tmp_path / "s"), first["name"]).stats()["triples"] == len(ODD)
    assert {r["triples"] for r in e.versions(str(tmp_path / "s"))} == {1, len(ODD)}
    assert e.verify(str(tmp_path / "s"), first["name"]) and not e.verify(str(tmp_path / "s"), "none")
    assert e.rotate(str(tmp_path / "s"), 1) == [first["name"]] and e.rotate(str(tmp_path / "s"), 1) == []
    assert Engine.open(spark, str(tmp_path / "s")).stats()["triples"] == 1 and not e.verify(str(tmp_path / "s"), first["name"])


def test_statistics(spark):
    e = Engine(spark)
    e.insert([(IRI(f"{E}{i}"), IRI(E + "n"), Literal(str(i), INTEGER)) for i in range(100)] + ODD)
    assert {r.p: r["count"] for r in stats.predicate_histogram(e.store).collect()}[E + "n"] == 100
    rows = stats.numeric_histogram(e.store, E + "n", 10).collect()
    assert sum(r["count"] for r in rows) == 100 and len(rows) == 10
    assert stats.range_selectivity(e.store, E + "n", 0, 49.5) == pytest.approx(0.5, abs=0.03)
    assert stats.range_scan(e.store, E + "n", 10, 19).count() == 10 and stats.range_scan(e.store, E + "n", None, 4).count() == 5
    assert stats.range_selectivity(e.store, E + "p", 100) == stats.range_selectivity(e.store, "none") == 0


def test_stream(spark, tmp_path):
    from ternion.reason.rules import rules_of

    source = tmp_path / "in"
    source.mkdir()
    sub = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    (source / "1.nt").write_text(f"<http://e/A> {sub} <http://e/B> .\n")
    e = Engine(spark)
    for _ in range(2):  # nothing is loaded twice
        ingest(e, str(source), str(tmp_path / "ck"), rules_of("rdfs")).awaitTermination()
    assert e.stats()["triples"] == 1
    (source / "2.nt").write_text(f"<http://e/B> {sub} <http://e/C> .\n<http://e/x> <{RDF}type> <http://e/A> .\n")
    ingest(e, str(source), str(tmp_path / "ck"), rules_of("rdfs")).awaitTermination()
    assert {r.t for r in e.sparql(P + "SELECT ?t { :x a ?t }").collect()} == {E + c for c in "ABC"}


def test_triples_of_tables_are_dealt_out(spark, tmp_path):
    """A table in one small file has many rows: its triples are not all told apart in one task."""
    from pyspark.sql import functions as F

    from ternion.sources import mapping

    rows = spark.range(200_000).select("id", F.concat(F.lit("name"), F.col("id") % 1000).alias("name"))
    rows.union(rows.limit(5)).coalesce(1).write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    tab = mapping.table(frame, "t", "id", "http://e/")
    before, mapping.CELL_BYTES = mapping.CELL_BYTES, mapping._bytes(tab) * 3 / 7
    try:
        made = Engine(spark, [tab]).triples()
    finally:
        mapping.CELL_BYTES = before
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and ", 7), REPARTITION_BY_NUM" in plan
    assert made.count() == made.distinct().count() == 600_000
