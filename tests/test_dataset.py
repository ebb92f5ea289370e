from datetime import timedelta

import pytest

from trellis.dataset import GraphDataset
from trellis.functions.terms import PROV, RDF, decode
from trellis.model import MembraneBreachError, MembraneHealth, ProjectionPipelineSpec, ProjectionPipelineStep, SealedPortalError, TransformNotFoundError
from trellis.operators.projection import Pipeline, collapse_reification_lpg, project_to_lpg
from trellis.operators.scope import CustomSPARQL, HasClassInInterior
from trellis.operators.store import AbstractGraphStore, Graph, GraphStore, SparkStore

SHAPE = "@prefix x: <urn:x:> . [] a sh:NodeShape ; sh:targetClass x:{cls} ; sh:property [ sh:path x:{path} ; sh:minCount 1 ; {more} sh:message \"needs {path}\" ] ."


@pytest.fixture
def ds(spark):
    return GraphDataset(spark, load_ontology=False, metadata_updates="off")


@pytest.fixture
def pair(ds):
    for h in ("source", "target"):
        ds.add_holon(f"urn:h:{h}", h.capitalize())
    ds.add_interior("urn:h:source", '@prefix x: <urn:x:> . x:1 a x:Record ; x:name "Alpha" ; x:value 42 . x:2 a x:Record ; x:name "Beta" ; x:value 99 .')
    ds.add_boundary("urn:h:target", SHAPE.format(cls="Item", path="label", more=""))
    ds.add_portal("urn:p:1", "urn:h:source", "urn:h:target", "PREFIX x: <urn:x:> CONSTRUCT { ?s a x:Item ; x:label ?n ; x:amount ?v } WHERE { ?s a x:Record ; x:name ?n ; x:value ?v }")
    return ds


def test_store_crud_and_queries(spark):
    s = SparkStore(spark)
    assert isinstance(s, GraphStore) and isinstance(s, AbstractGraphStore)
    s.parse_into("urn:g", "@prefix : <urn:x:> . :a :val 42 . :b :val 99 . :a :knows :b .")
    assert s.graph_exists("urn:g") and not s.graph_exists("urn:no") and s.get_graph("urn:no") == Graph()
    assert s.query("SELECT ?v WHERE { ?s <urn:x:val> ?v } ORDER BY ?v") == [{"v": 42}, {"v": 99}]
    assert s.query("SELECT ?o WHERE { ?s <urn:x:knows> ?o }", s="urn:x:a") == [{"s": "urn:x:a", "o": "urn:x:b"}] or s.query("SELECT ?o WHERE { ?s <urn:x:knows> ?o }", s="urn:x:a") == [{"o": "urn:x:b"}]
    assert s.ask("ASK { <urn:x:a> <urn:x:val> 42 }") and not s.ask("ASK { <urn:x:a> <urn:x:val> 43 }")
    s.update("DELETE DATA { GRAPH <urn:g> { <urn:x:a> <urn:x:val> 42 } } ; INSERT DATA { GRAPH <urn:h> { <urn:x:c> <urn:x:val> 1 } }")
    assert s.list_named_graphs() == ["urn:g", "urn:h"] and len(s.get_graph("urn:g")) == 2
    s.update("DELETE { GRAPH ?g { ?s <urn:x:val> ?v } } INSERT { GRAPH ?g { ?s <urn:x:big> ?v } } WHERE { GRAPH ?g { ?s <urn:x:val> ?v FILTER(?v > 50) } }")
    assert s.get_graph("urn:g") == {("<urn:x:a>", "<urn:x:knows>", "<urn:x:b>"), ("<urn:x:b>", "<urn:x:big>", '"99"^^<http://www.w3.org/2001/XMLSchema#integer>')}
    s.update("DROP GRAPH <urn:h>")
    s.delete_graph("urn:h")
    assert s.list_named_graphs() == ["urn:g"]
    t = SparkStore(spark)
    t.load(s.quads)
    assert t.get_graph("urn:g") == s.get_graph("urn:g")
    t.update("DELETE WHERE { GRAPH <urn:g> { ?s <urn:x:big> ?v } }")
    assert len(t.get_graph("urn:g")) == 1
    assert Graph.parse(s.export_graph("urn:g")) == s.get_graph("urn:g")
    with pytest.raises(ValueError):
        s.export_graph("urn:none")


def test_labels_round_trip_and_iris_are_checked(ds):
    text = 'quote " back\\slash\nnewline \\n'
    ds.add_holon("urn:h:1", text)
    assert ds.get_holon("urn:h:1").label == text
    assert ds.query("SELECT (STR(?l) AS ?x) WHERE { ?s <http://www.w3.org/2000/01/rdf-schema#label> ?l }") == [{"x": text}]
    for bad in ("", "urn:a b", "urn:<", "urn:>", 'urn:"', "urn:{"):
        with pytest.raises(ValueError):
            ds.add_holon(bad)


def test_traverse_validates_and_records(pair):
    out, result = pair.traverse("urn:h:source", "urn:h:target", agent_iri="urn:agent")
    assert len(out) == 6 and result.health == MembraneHealth.INTACT
    trail = pair.collect_audit_trail()
    assert [(t.source_iri, t.target_iri) for t in trail.traversals] == [("urn:h:source", "urn:h:target")] and trail.validations[0].health == "intact"
    assert trail.derivation_chain == [("urn:h:target", "urn:h:source")] and trail.participating_holons == {"urn:h:source", "urn:h:target"}
    assert pair.get_activity(trail.validations[0].activity_iri).holon_iri == "urn:h:target"
    assert not pair.is_stale("urn:h:target") and pair.is_stale("urn:h:source") and pair.stale_holons(timedelta(hours=1)) == ["urn:h:source"]
    assert pair.derivation_chain("urn:h:target") == ["urn:h:source"]
    pair.traverse("urn:h:source", "urn:h:target", agent_iri="urn:agent")
    assert "no change" in pair.last_traversal("urn:h:target").label
    assert len(pair.portal_traversal_history("urn:p:1")) == 2
    assert pair.rollback_traversal(trail.traversals[0].activity_iri) == 6 and pair.compose(["urn:h:target"]) == Graph()


def test_breach_rolls_back(pair):
    pair.add_interior("urn:h:target", "@prefix x: <urn:x:> . x:bad a x:Item .")
    before = pair.compose(["urn:h:target"])
    with pytest.raises(MembraneBreachError):
        pair.traverse("urn:h:source", "urn:h:target", fail_on_breach=True)
    assert pair.compose(["urn:h:target"]) == before
    _, result = pair.dry_run("urn:h:source", "urn:h:target")
    assert result.health == MembraneHealth.COMPROMISED and pair.compose(["urn:h:target"]) == before
    assert [v.focus_node for v in result.shape_violations] == ["urn:x:bad"]


def test_portals_paths_and_scope(ds):
    for h in "abcd":
        ds.add_holon(f"urn:{h}", h.upper(), member_of="urn:root" if h != "a" else None)
        ds.add_interior(f"urn:{h}", f"@prefix x: <urn:x:> . x:{h} a x:K{h} .")
    for a, b in ("ab", "bc", "cd"):
        ds.add_portal(f"urn:p:{a}{b}", f"urn:{a}", f"urn:{b}", portal_type="IconPortal")
    assert [p.iri for p in ds.find_path("urn:a", "urn:c")] == ["urn:p:ab", "urn:p:bc"]
    assert ds.find_path("urn:c", "urn:a") is None and ds.find_path("urn:a", "urn:a") is None
    assert [(m.iri, m.distance) for m in ds.resolve(HasClassInInterior("urn:x:Kc"), "urn:a")] == [("urn:c", 2)]
    assert ds.resolve(HasClassInInterior("urn:x:Kd"), "urn:a", max_depth=2) == []
    assert [(m.iri, m.distance) for m in ds.resolve(HasClassInInterior("urn:x:Ka"), "urn:d", order="reverse-network")] == [("urn:a", 3)]
    assert ds.resolve(CustomSPARQL("ASK { GRAPH <{holon_iri}/interior> { ?s a <urn:x:Kb> } }"), "urn:a")[0].iri == "urn:b"
    with pytest.raises(ValueError):
        ds.resolve(HasClassInInterior("urn:x:Kc"), "urn:a", order="sideways")
    n = ds.holon_neighborhood("urn:b")
    assert [x.key for x in n.nodes] == ["urn:a", "urn:b", "urn:c"] and [e.key for e in n.edges] == ["edge-0001", "edge-0002"]
    assert n.to_graphology()["nodes"][0]["attributes"]["label"] == "A"
    with pytest.raises(ValueError):
        ds.holon_neighborhood("urn:b", -1)
    with pytest.raises(ValueError):
        ds.traverse_portal("urn:p:ab")
    ds.update_portal("urn:p:ab", label="new", portal_type="SealedPortal")
    assert ds.find_portals_from("urn:a")[0].label == "new"
    with pytest.raises(SealedPortalError):
        ds.traverse_portal("urn:p:ab")
    tree = ds.compute_depth()
    assert tree["urn:b"] == 1 and tree["urn:root"] == 0 and "└── D" in str(tree)
    assert ds.remove_holon("urn:b") and not ds.remove_holon("urn:b")
    assert [p.iri for p in ds.list_portals()] == ["urn:p:cd"]


@pytest.mark.parametrize("more, health", [("", MembraneHealth.COMPROMISED), ("sh:severity sh:Warning ;", MembraneHealth.WEAKENED), ("sh:severity sh:Info ;", MembraneHealth.INTACT)])
def test_membrane_states(ds, more, health):
    ds.add_holon("urn:h")
    ds.add_interior("urn:h", "@prefix x: <urn:x:> . x:1 a x:Item . x:2 a x:Sub ; x:label \"fine\" . x:Sub rdfs:subClassOf x:Item .")
    assert ds.validate_membrane("urn:h").report_text == "No boundary shapes defined."
    ds.add_boundary("urn:h", SHAPE.format(cls="Item", path="label", more=more))
    result = ds.validate_membrane("urn:h")
    assert result.health == health and [v.focus_node for v in result.shape_violations] == ([] if health == MembraneHealth.INTACT else ["urn:x:1"])


def test_shacl_constraints(ds):
    ds.add_holon("urn:h")
    ds.add_interior("urn:h", """@prefix x: <urn:x:> . x:ok a x:T ; x:n 5 ; x:k "a" ; x:r x:ok . x:bad a x:T ; x:n "text", 50 ; x:k "zzz" ; x:r "lit" ; x:other 1 .""")
    ds.add_boundary("urn:h", """@prefix x: <urn:x:> . x:S a sh:NodeShape ; sh:targetClass x:T ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ;
      sh:property [ sh:path x:n ; sh:datatype xsd:integer ; sh:maxCount 1 ; sh:maxInclusive 10 ] ; sh:property [ sh:path x:k ; sh:in ( "a" "b" ) ; sh:pattern "^[ab]$" ; sh:maxLength 1 ] ;
      sh:property [ sh:path x:r ; sh:nodeKind sh:IRI ; sh:class x:T ] ;
      sh:sparql [ sh:select "SELECT $this WHERE { GRAPH ?g { $this <urn:x:n> ?v . FILTER(?v > 40) } }" ; sh:message "too big" ] .""")
    rows = ds.validate_membrane("urn:h").shape_violations
    assert {r.focus_node for r in rows} == {"urn:x:bad"} and len(rows) == 11


def test_metadata(spark):
    ds = GraphDataset(spark, load_ontology=False)
    ds.add_holon("urn:h")
    for _ in range(2):
        ds.add_interior("urn:h", "@prefix x: <urn:x:> . x:a a x:Thing . x:b a x:Thing .")
    m = ds.get_graph_metadata("urn:h/interior")
    assert m.triple_count == 2 and [(c.class_iri, c.count) for c in m.class_inventory] == [("urn:x:Thing", 2)] and ds.get_graph_metadata("urn:none") is None
    assert ds.get_holon_detail("urn:h").interior_triple_count == 2 and ds.refresh_all_metadata() == 1
    assert len(ds.store.rows(ds.registry, "<urn:h/interior>", ds.cga("refreshedAt"))) == 1 and ds.migrate_registry() == []
    with pytest.raises(ValueError):
        GraphDataset(spark, metadata_updates="sometimes")


def test_rdfs_is_idempotent(ds):
    ds.add_holon("urn:h")
    ds.add_interior("urn:h", "@prefix x: <urn:x:> . x:Dog rdfs:subClassOf x:Animal . x:rex a x:Dog ; x:owner x:ann . x:owner rdfs:range x:Person .")
    for _ in range(2):
        got = ds.store.get_graph(ds.materialize_rdfs("urn:h"))
        assert got == {("<urn:x:rex>", f"<{RDF}type>", "<urn:x:Animal>"), ("<urn:x:ann>", f"<{RDF}type>", "<urn:x:Person>")}


def test_lpg():
    g = Graph.parse("""@prefix x: <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . x:alice a x:P ; rdfs:label "Alice" ; x:age 30 ; x:knows x:bob ; x:address [ x:city "C" ; x:zip "1" ] ; x:skills ( "a" "b" ) .""")
    out = project_to_lpg(g)
    a = out.nodes["urn:x:alice"]
    assert a.types == ["urn:x:P"] and a.label == "Alice" and a.attributes["urn:x:age"] == 30 and a.attributes["urn:x:skills"] == ["a", "b"] and a.attributes["urn:x:address"] == {"city": "C", "zip": "1"}
    assert set(out.nodes) == {"urn:x:alice", "urn:x:bob"} and [(e.source, e.target) for e in out.edges] == [("urn:x:alice", "urn:x:bob")]
    s = Graph.parse(f"@prefix x: <urn:x:> . @prefix rdf: <{RDF}> . x:s a rdf:Statement ; rdf:subject x:a ; rdf:predicate x:p ; rdf:object x:b ; x:confidence 0.95 .")
    assert [float(e.attributes["urn:x:confidence"]) for e in collapse_reification_lpg(s).edges] == [0.95]


def test_pipelines(ds):
    ds.add_holon("urn:h")
    ds.add_interior("urn:h", '@prefix x: <urn:x:> . x:a a x:Thing ; x:label "A" . x:b a x:Thing ; x:label "B" . [] a x:Hidden .')
    assert len(ds.apply_pipeline("urn:h", Pipeline().add("clean", "strip_blank_nodes"))) == 4
    spec = ProjectionPipelineSpec("urn:spec", "mine", [ProjectionPipelineStep("clean", "strip_blank_nodes"), ProjectionPipelineStep("things", None, "CONSTRUCT { ?s a <urn:x:Thing> } WHERE { ?s a <urn:x:Thing> }")])
    with pytest.raises(TransformNotFoundError):
        ds.register_pipeline(ProjectionPipelineSpec("urn:bad", "bad", [ProjectionPipelineStep("x", "no_such")]))
    ds.register_pipeline(spec)
    ds.attach_pipeline("urn:h", "urn:spec")
    assert ds.get_pipeline("urn:spec") == spec and ds.list_pipelines("urn:h")[0].step_count == 2
    out = ds.run_projection("urn:h", "urn:spec", "urn:h/projection/p")
    assert {decode(s) for s, _, _ in out} == {"urn:x:a", "urn:x:b"} and ds.layers("urn:h", "projection") == ["urn:h/projection/p"]
    assert any(q[2] == f"<{PROV}endedAtTime>" for q in ds.store.rows("urn:h/context"))


def test_registry_shapes(spark):
    from trellis.operators import shacl

    ds = GraphDataset(spark, metadata_updates="off")
    ds.add_holon("urn:a", "A")
    ds.add_holon("urn:b", "B", member_of="urn:b")
    ds.add_portal("urn:p1", "urn:a", "urn:b")
    ds.add_portal("urn:p2", "urn:a", "urn:b", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SealedPortal")
    rows = shacl.validate(ds._frame([ds.registry]), ds.store.get_graph("urn:holarchy:ontology:shapes"), ds.quads).collect()
    assert sorted((decode(r.focus), r.severity.rsplit("#", 1)[1]) for r in rows) == [("urn:b", "Violation"), ("urn:p1", "Violation"), ("urn:p2", "Warning")]


def test_registry_shapes_of_every_kind(spark):
    from trellis.operators import shacl

    ds = GraphDataset(spark, metadata_updates="off")
    p = ds.cga("")[1:-1] if ds.cga("").startswith("<") else ds.cga("")
    ds.store.parse_into(ds.registry, f"""@prefix c: <{p}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix prov: <http://www.w3.org/ns/prov#> . @prefix : <urn:x:> .
:ok a c:Holon, c:DataHolon ; rdfs:label "ok" ; c:dataSteward :me ; c:dataClassification :open ; c:materializationMode "cached" . :open a c:ClassificationLevel . :shut a c:ClassificationLevel .
:old a c:Holon ; c:holonStatus c:Archived ; c:dataClassification :shut ; c:materializationMode "elsewhere" ; c:memberOf :nobody .
:door a c:Portal ; rdfs:label "door" ; c:sourceHolon :ok ; c:targetHolon :old .
:gap a c:Portal ; rdfs:label "gap" ; c:sourceHolon :ok ; c:targetHolon :nobody .
:split a c:HolonSplit ; prov:used :ok ; prov:generated :one . :domain a c:DataDomain . :system a c:ExternalSystem ; rdfs:label "s" .
:agent a c:AgentHolon . :step a c:ProjectionPipelineStep . :spec a c:ProjectionPipelineSpec ; rdfs:label "spec" ; c:hasStep :step .""")
    rows = shacl.validate(ds._frame([ds.registry]), ds.store.get_graph("urn:holarchy:ontology:shapes"), ds.quads).collect()
    found = {(decode(r.focus)[6:], r.message) for r in rows}
    assert found == {
        ("old", "An archived unit names its successor."), ("old", "One of the four modes."), ("old", "The parent is no unit."),
        ("door", "An active portal leads to an archived unit."), ("door", "The portal joins units of different classification."), ("gap", "The target is no unit."),
        ("split", "A split has two results or more."), ("split", "A split has a reason."), ("split", "A split has a time."), ("domain", "A domain has one label."), ("system", "A system has one type."),
        ("agent", "An agent has a label."), ("agent", "An agent keeps its state in an interior."), ("agent", "An agent's output has a boundary."), ("agent", "An agent's history has a context."),
        ("step", "A step has a transform or a query."),
    }


def test_projection_scope_hides_the_interior(ds):
    ds.add_holon("urn:hr")
    ds.add_holon("urn:dir")
    ds.add_interior("urn:hr", '@prefix x: <urn:x:> . x:e a x:Employee ; x:name "N" ; x:ssn "1" .')
    ds.add_projection("urn:hr", '@prefix x: <urn:x:> . x:e a x:Employee ; x:name "N" .')
    ds.add_portal("urn:p", "urn:hr", "urn:dir", "CONSTRUCT { ?s ?p ?o } WHERE { ?s a <urn:x:Employee> ; ?p ?o }")
    assert {decode(p) for _, p, _ in ds.traverse_portal("urn:p")} == {f"{RDF}type", "urn:x:name"}
