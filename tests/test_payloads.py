"""Payload builders on small graphs; styling as columns against the functions."""

from trellis import payloads as P
from trellis.dataset import GraphDataset
from trellis.functions.terms import SH
from trellis.model import AuditTrail, ProjectedEdge, ProjectedGraph, ProjectedNode, SurfaceReport, TraversalRecord, ValidationRecord

URIS = ["urn:x:Holon", "http://a/b#C", "http://a/b/", "plain", "urn:x:memberOf", "http://www.w3.org/ns/prov#used", "urn:x:sourceHolon", "urn:x:realizes", "http://a/" + "n" * 60, "urn:x:NodeShape", "urn:x:Activity", "urn:x:subClassOf", "urn:x:TransformPortal", "a#"]


def test_styles(spark):
    assert [P.shorten_uri(u) for u in URIS[:4]] == ["Holon", "C", "//a/b/", "plain"] and len(P.shorten_uri(URIS[8])) == 40
    assert [P.classify_edge(u) for u in URIS[4:8]] == ["membership", "provenance", "portal", "realization"] and P.edge_color("urn:x:other") == "#94a3b8"
    assert (P.color_for_layer("boundary"), P.color_for_layer("?"), P.color_for_layer("?", light=True), P.shape_for_layer("portal"), P.shape_for_layer("?")) == ("#a855f7", "#64748b", "#f8fafc", "diamond", "rectangle")
    rows = P.edge_rows(spark.createDataFrame([("a", u, "b") for u in URIS], "source string, predicate string, target string")).collect()
    assert [(r.label, r.kind, r.color) for r in sorted(rows, key=lambda r: URIS.index(r.predicate))] == [(P.shorten_uri(u), P.classify_edge(u), P.edge_color(u)) for u in URIS]
    types = [[], ["urn:x:Thing"], ["urn:x:Thing", "urn:x:Portal", "urn:x:Holon"], *([u] for u in URIS)]
    got = P.node_rows(spark.createDataFrame([(str(k), t) for k, t in enumerate(types)], "iri string, types array<string>"), "context").collect()
    assert {(int(r.iri), r.layer, r.type) for r in got} == {(k, P.infer_layer(t, "context"), P.shorten_uri(t[0]) if t else "default") for k, t in enumerate(types)}


def test_labels():
    n = ProjectedNode("urn:x:a", ["urn:x:T", "urn:x:U"], "A", {"iri": "urn:x:a", "urn:x:long": "y" * 50, "urn:x:l": [1, 2], "urn:x:m": [1, 2, 3, 4], "urn:x:d": {"k": 1}})
    assert P.format_simple(n) == "A" and P.format_simple(ProjectedNode("urn:x:b")) == "b" and P.format_typed(n) == "«T»\nA"
    assert P.format_compartmented(n).split("\n") == ["«T, U»", "A", "─" * 12, "  long: " + "y" * 34 + "…", "  l: [1, 2]", "  m: [4 items]", "  d: {...1 fields}"]
    assert P.format_compartmented(n, max_attrs=1).split("\n")[-1] == "  ... +3 more" and P.format_compartmented(ProjectedNode("urn:x:b")) == "b"
    shape = ProjectedNode("urn:x:S", [SH + "NodeShape"], None, {SH + "targetClass": "urn:x:T", SH + "closed": True, SH + "property": [{"path": "urn:x:p", "minCount": 1, "datatype": "http://www.w3.org/2001/XMLSchema#string", "severity": SH + "Warning"}, {"path": "urn:x:q"}]})
    assert P.format_shacl_shape(shape).split("\n") == ["«NodeShape»", "T", "─" * 20, f"  ⚠ {'p':15s} {'[string]':10s} 1..*", f"  · {'q':15s} 0..*", "─" * 20, "  [closed]"]


def test_builders(spark):
    ds = GraphDataset(spark, load_ontology=False, metadata_updates="off")
    ds.add_holon("urn:a", "A")
    ds.add_holon("urn:b", "B", member_of="urn:a")
    ds.add_interior("urn:a", '@prefix x: <urn:x:> . x:e a x:Thing ; x:n "1" ; x:to x:f .')
    ds.add_boundary("urn:a", "@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:x:S> a sh:NodeShape ; sh:targetClass <urn:x:Thing> ; sh:property [ sh:path <urn:x:n> ; sh:minCount 1 ] .")
    ds.add_portal("urn:p", "urn:a", "urn:b", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", label="P")
    nodes, edges = P.holon_to_yfiles(ds, "urn:a")
    by = {n["id"]: n["properties"] for n in reversed(nodes)}  # the boundary also names the unit, as its portal's source
    assert by["urn:a"]["is_group"] and by["urn:a/interior"]["parent"] == "urn:a" and by["urn:x:e"]["parent"] == "urn:a/interior" and by["urn:x:e"]["layer"] == "interior"
    assert by["urn:x:S"]["layer"] == "boundary" and by["urn:x:S"]["label"].startswith("«NodeShape»\nS\n") and "n" in by["urn:x:S"]["label"]
    assert [(e["start"], e["end"], e["properties"]["label"]) for e in edges if e["properties"]["layer"] == "interior"] == [("urn:x:e", "urn:x:f", "to")]
    assert {n["id"] for n in P.holon_to_yfiles(ds, "urn:a", ["interior"], show_group=False)[0]} == {"urn:x:e", "urn:x:f"} and P.holon_to_yfiles(ds, "urn:none", show_group=False) == ([], [])
    inside = P.holarchy_to_yfiles(ds, show_internals=True)
    assert ("urn:a", "urn:b", "P") in [(e["start"], e["end"], e["properties"]["label"]) for e in inside[1]] and {"urn:a", "urn:b", "urn:x:e"} <= {n["id"] for n in inside[0]}
    plain = P.holarchy_to_yfiles(ds)
    assert {"urn:a", "urn:b"} <= {n["id"] for n in plain[0]} and ("urn:b", "urn:a") in {(e["start"], e["end"]) for e in plain[1]}
    assert P.projected_to_yfiles(ProjectedGraph({}, [ProjectedEdge("a", "urn:x:p", "b", {"w": 1})]))[1][0]["properties"]["edge_attrs"] == {"w": 1}


def test_audit():
    trail = AuditTrail([TraversalRecord("urn:act", "urn:a", "urn:b", "urn:agent:me", "door", "2024-01-02T03:04:05+00:00")], [ValidationRecord("urn:v", "urn:b", "intact")], [], {"urn:b": SurfaceReport("urn:b", ["urn:x/T"], [f"f{k}" for k in range(8)], ["o"])})
    nodes, edges = P.audit_trail_to_yfiles(trail)
    assert [n["properties"]["health"] for n in nodes] == ["UNKNOWN", "INTACT"]
    assert nodes[1]["properties"]["label"].split("\n") == ["b", "✓ INTACT", "─" * 14, "accepts: T", "required: f0, f1, f2, f3, f4, f5 +2", "optional: o"]
    assert edges[0]["properties"]["label"] == "door\nagent: me\n2024-01-02 03:04:05" and edges[0]["properties"]["hop_number"] == 1
    assert P.audit_trail_to_yfiles(trail, show_surface=False, show_agents=False)[0][1]["properties"]["label"] == "b\n✓ INTACT" and P.audit_trail_to_yfiles(AuditTrail()) == ([], [])


def test_presets(spark):
    ds = GraphDataset(spark, load_ontology=False, metadata_updates="off")
    ds.add_holon("urn:a", "A")
    ds.add_holon("urn:b", "B", member_of="urn:a")
    ds.add_portal("urn:p", "urn:a", "urn:b", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", label="P")
    ds.add_boundary("urn:a", "@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:x:S> a sh:NodeShape ; sh:property [ sh:path <urn:x:n> ; sh:minCount 1 ] .")
    ds.add_projection("urn:a", f"<urn:a> <{ds.cga('bindsTo')[1:-1]}> <urn:ext> .")
    ds.record_traversal("urn:a", "urn:b", "urn:me")
    out = {title: ds.construct(q["query"]) for title, q in P.presets(ds.cga("")[1:-1]).items()}
    has = lambda title, s, tail: any(t[0] == f"<{s}>" and t[1].endswith(tail + ">") for t in out[title])
    assert len(out) == 6 and has("Holarchy Structure", "urn:b", "memberOf") and has("Holarchy Structure", "urn:p", "targetHolon") and has("Portal Network", "urn:p", "label")
    assert has("SHACL Shapes", "urn:x:S", "property") and any(p.endswith("minCount>") for _, p, _ in out["SHACL Shapes"])
    assert any(p.endswith("wasAssociatedWith>") for _, p, _ in out["Provenance Trail"]) and len(out["External Bindings"]) == 1
    assert out["Object Properties Only"] and all(o.startswith("<") and not p.endswith("#type>") for _, p, o in out["Object Properties Only"])
    assert not has("Portal Network", "urn:b", "memberOf")
