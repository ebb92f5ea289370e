"""Node and edge lists for graph widgets: each node is {id, properties}, each edge {id, start, end, properties}.

The builders take what the facade returns (property graphs, audit trails), which has the size of a picture. `node_rows` and `edge_rows`
make the same styling as columns, for frames of any size."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.terms import RDF, RDFS, SH
from trellis.model import AuditTrail, ProjectedGraph, ProjectedNode
from trellis.operators.projection import project_to_lpg

# Looks of the layers, and colours of the kinds of edges.
LAYER_COLORS = {
    "interior": "#3b82f6",
    "boundary": "#a855f7",
    "projection": "#22c55e",
    "context": "#f59e0b",
    "portal": "#ef4444",
    "holon": "#6b7280",
    "alignment": "#06b6d4",
    "literal": "#94a3b8",
    "default": "#64748b",
}
LAYER_COLORS_LIGHT = {
    "interior": "#dbeafe",
    "boundary": "#f3e8ff",
    "projection": "#dcfce7",
    "context": "#fef3c7",
    "portal": "#fee2e2",
    "holon": "#f3f4f6",
    "alignment": "#cffafe",
    "default": "#f8fafc",
}
LAYER_SHAPES = {
    "interior": "round-rectangle",
    "boundary": "hexagon",
    "projection": "pill",
    "context": "octagon",
    "portal": "diamond",
    "holon": "round-rectangle",
    "shape": "hexagon",
    "literal": "ellipse",
    "default": "rectangle",
}
EDGE_COLORS = {
    "portal": "#ef4444",
    "membership": "#f59e0b",
    "type_hierarchy": "#7c3aed",
    "provenance": "#06b6d4",
    "realization": "#22c55e",
    "default": "#94a3b8",
}
# Parts of a predicate, in lower case, that make the kind of an edge; the first kind that fits counts.
EDGE_PARTS = {
    "portal": ["portal", "sourceholon", "targetholon"],
    "membership": ["memberof", "adjacentto"],
    "type_hierarchy": ["subclassof", "subpropertyof"],
    "provenance": ["prov", "derived", "generated"],
    "realization": ["realizes"],
}
# Parts of a type, in lower case, that make the layer of a node.
TYPE_PARTS = {"boundary": ["shape"], "holon": ["holon"], "portal": ["portal"], "context": ["activity"]}
# Parts of attribute names, in lower case, that no label shows.
HIDDEN = ["rdf-syntax-ns#type", "label", "22-rdf-syntax", "iri"]
MARKS = {"Violation": "✗", "Warning": "⚠"}
HEALTH_MARKS = {"INTACT": "✓", "WEAKENED": "⚠", "COMPROMISED": "✗"}
ROLES = ("interior", "boundary", "projection", "context")


def _first_fit(text: str, parts: dict[str, list[str]], default: str) -> str:
    text = text.lower()
    return next((kind for kind, wanted in parts.items() if any(x in text for x in wanted)), default)


def shorten_uri(uri: str, max_len: int = 40) -> str:
    """What stands behind the last #, else the last /, else the last colon, if anything does; cut to max_len."""
    tails = (uri.rpartition(mark)[2] for mark in "#/:" if mark in uri)
    return next(filter(None, tails), uri)[:max_len]


def classify_edge(predicate: str) -> str:
    return _first_fit(predicate, EDGE_PARTS, "default")


def edge_color(predicate: str) -> str:
    return EDGE_COLORS[classify_edge(predicate)]


def color_for_layer(layer: str, light: bool = False) -> str:
    colors = LAYER_COLORS_LIGHT if light else LAYER_COLORS
    return colors.get(layer, colors["default"])


def shape_for_layer(layer: str) -> str:
    return LAYER_SHAPES.get(layer, LAYER_SHAPES["default"])


def infer_layer(types: Iterable[str], default: str = "default") -> str:
    """The layer that the first telling type gives."""
    return next((x for x in (_first_fit(t, TYPE_PARTS, "") for t in types) if x), default)


# Labels
Label = Callable[[ProjectedNode], str]


def _name(node: ProjectedNode) -> str:
    return node.label or shorten_uri(node.iri)


def _cut(rows: list[str], most: int) -> list[str]:
    return rows[:most] + ([f"  ... +{len(rows) - most} more"] if len(rows) > most else [])


def _shown(value, most: int) -> str:
    if isinstance(value, dict):
        return f"{{...{len(value)} fields}}"
    if isinstance(value, list):
        return f"[{len(value)} items]" if len(value) > 3 else "[" + ", ".join(str(x)[:15] for x in value) + "]"
    text = str(value)
    return text if len(text) <= most else text[: most - 1] + "…"


def format_simple(node: ProjectedNode) -> str:
    return _name(node)


def format_typed(node: ProjectedNode) -> str:
    return "\n".join([*(f"«{shorten_uri(t)}»" for t in node.types[:1]), _name(node)])


def format_compartmented(node: ProjectedNode, max_attrs: int = 8, max_value_len: int = 35, show_types: bool = True) -> str:
    """Types, name and attributes, the latter under a rule."""
    head = [f"«{', '.join(map(shorten_uri, node.types[:3]))}»"] if show_types and node.types else []
    name = _name(node)
    rows = [f"  {shorten_uri(k)}: {_shown(v, max_value_len)}" for k, v in node.attributes.items() if not any(x in k.lower() for x in HIDDEN)]
    return "\n".join([*head, name, *(["─" * max(12, len(name))] if rows else []), *_cut(rows, max_attrs)])


def _of(values: dict, name: str):
    """An attribute by its full or its local name."""
    return values.get(SH + name, values.get(name))


def _constraint(p) -> str:
    if not isinstance(p, dict):
        return f"  · {p}"
    severity, kind, least, most = (_of(p, x) for x in ("severity", "datatype", "minCount", "maxCount"))
    mark = _marked(str(severity)) if severity else "·"
    path = _of(p, "path")
    path = "?" if path is None else shorten_uri(path) if isinstance(path, str) else str(path)
    kind = f" {f'[{shorten_uri(str(kind))}]':10s}" if kind else ""
    return f"  {mark} {path:15s}{kind} {0 if least is None else least}..{'*' if most is None else most}"


def _marked(severity: str) -> str:
    return next((mark for name, mark in MARKS.items() if name in severity), "ℹ")


def format_shacl_shape(node: ProjectedNode, max_props: int = 10) -> str:
    """A shape's target and its properties: severity, path, datatype, cardinality."""
    target, props, rule = _of(node.attributes, "targetClass"), _of(node.attributes, "property"), "─" * 20
    rows = [_constraint(p) for p in (props if isinstance(props, list) else [props])] if props else []
    head = shorten_uri(node.iri) if not target else shorten_uri(target) if isinstance(target, str) else str(target)
    return "\n".join(["«NodeShape»", head, *([rule] if rows else []), *_cut(rows, max_props), *([rule, "  [closed]"] if _of(node.attributes, "closed") else [])])


# Builders
Payload = tuple[list[dict], list[dict]]


def _group(id: str, label: str | None, layer: str, kind: str, **more) -> dict:
    return {"id": id, "properties": {"label": label, "layer": layer, "type": kind, "is_group": True, **more}}


def projected_to_yfiles(lpg: ProjectedGraph, layer: str = "default", label_fn: Label = format_compartmented, parent_id: str | None = None) -> Payload:
    """A property graph as nodes and edges; shapes have labels of their own."""
    nodes = []
    for key, n in lpg.nodes.items():
        label = format_shacl_shape if any("NodeShape" in t for t in n.types) else label_fn
        looks = {"iri": n.iri, "label": label(n), "layer": infer_layer(n.types, layer), "type": shorten_uri(n.types[0]) if n.types else "default", "types": n.types, "attr_count": len(n.attributes), "is_group": False}
        nodes.append({"id": key, "properties": looks | ({"parent": parent_id} if parent_id else {})})
    edges = []
    for k, e in enumerate(lpg.edges):
        looks = {"label": shorten_uri(e.predicate), "predicate": e.predicate, "layer": layer}
        edges.append({"id": f"e_{k}", "start": e.source, "end": e.target, "properties": looks | ({"edge_attrs": e.attributes} if e.attributes else {})})
    return nodes, edges


def sparql_result_to_yfiles(triples, layer: str = "default", label_fn: Label = format_compartmented) -> Payload:
    """The triples of a CONSTRUCT."""
    return projected_to_yfiles(project_to_lpg(triples), layer, label_fn)


def holon_to_yfiles(ds, holon_iri: str, layers: Iterable[str] | None = None, show_group: bool = True, label_fn: Label = format_compartmented) -> Payload:
    """A unit's layers, each a group within the unit's group."""
    info = ds.get_holon(holon_iri)
    name = info.label if info else shorten_uri(holon_iri)
    nodes, edges = [_group(holon_iri, name, "holon", "holon")] if show_group else [], []
    for role in ROLES:
        graphs = ds.layers(holon_iri, role) if layers is None or role in layers else []
        if not graphs:
            continue
        group = f"{holon_iri}/{role}" if show_group else None
        if group:
            nodes.append(_group(group, f"{name} / {role}", role, "layer_group", parent=holon_iri))
        triples = frozenset().union(*(ds.store.get_graph(g) for g in graphs))
        more = projected_to_yfiles(project_to_lpg(triples), role, label_fn, group)
        nodes, edges = nodes + more[0], edges + more[1]
    return nodes, edges


def holarchy_to_yfiles(ds, show_internals: bool = False, layers: Iterable[str] | None = None, label_fn: Label = format_typed) -> Payload:
    """All units: one node each, or with show_internals each with its layers, and an edge for each portal."""
    if not show_internals:
        return projected_to_yfiles(ds.project_holarchy(), "holon", label_fn)
    parts = [holon_to_yfiles(ds, h.iri, layers, True, label_fn) for h in ds.list_holons()]
    portals = [{"id": f"portal_e_{k}", "start": p.source_iri, "end": p.target_iri, "properties": {"label": p.label or "portal", "predicate": "cga:portal", "layer": "portal"}} for k, p in enumerate(ds.list_portals())]
    return list(itertools.chain.from_iterable(x[0] for x in parts)), [*itertools.chain.from_iterable(x[1] for x in parts), *portals]


def _tail(text: str) -> str:
    return text.rpartition(":")[2]


def _few(head: str, names: list[str], most: int) -> list[str]:
    return [f"{head}: {', '.join(names[:most])}" + (f" +{len(names) - most}" if len(names) > most else "")] if names else []


def audit_trail_to_yfiles(audit: AuditTrail, show_surface: bool = True, show_agents: bool = True) -> Payload:
    """A node for each unit that takes part, with its health and its boundary's contract; an edge for each traversal, in order."""
    nodes, edges = [], []
    for h in sorted(audit.participating_holons):
        checked, surface = audit.validation_for(h), audit.surfaces.get(h)
        health = str(getattr(checked.health, "value", checked.health)).rpartition(":")[2].upper() if checked else "UNKNOWN"
        rows = [_tail(h), f"{HEALTH_MARKS.get(health, '?')} {health}" if checked else "· no validation"]
        if surface and show_surface:
            classes = [c.rpartition(":")[2].rpartition("/")[2] for c in surface.target_classes[:3]]
            rows += ["─" * max(14, len(rows[0])), *_few("accepts", classes, 3), *_few("required", surface.required_fields, 6), *_few("optional", surface.optional_fields, 4)]
        looks = {"label": "\n".join(rows), "holon_iri": h, "layer": "provenance", "health": health, "type": "audit_node", "is_group": False, "has_surface": surface is not None, "has_validation": checked is not None}
        nodes.append({"id": h, "properties": looks})
    for k, t in enumerate(audit.traversals):
        when = [str(t.timestamp)[:19].replace("T", " ")] if t.timestamp else []
        rows = [*([t.label] if t.label else []), *([f"agent: {_tail(t.agent_iri)}"] if show_agents and t.agent_iri else []), *when]
        looks = {"label": "\n".join(rows), "activity_iri": t.activity_iri, "portal_label": t.label or "", "agent": t.agent_iri or "", "timestamp": t.timestamp or "", "layer": "provenance", "hop_number": k + 1}
        edges.append({"id": f"traversal_{k}", "start": t.source_iri, "end": t.target_iri, "properties": looks})
    return nodes, edges


# The same as columns
def _short(uri: Column) -> Column:
    tails = [F.when(uri.contains(mark), F.nullif(F.substring_index(uri, mark, -1), F.lit(""))) for mark in "#/:"]
    return F.left(F.coalesce(*tails, uri), F.lit(40))


def _kind(text: Column, parts: dict[str, list[str]]) -> Column:
    """The first kind whose parts occur; null if none."""
    text = F.lower(text)
    return F.coalesce(*(F.when(F.greatest(*(text.contains(x) for x in [*wanted, *wanted])), F.lit(kind)) for kind, wanted in parts.items()))


def edge_rows(edges: DataFrame) -> DataFrame:
    """(source, predicate, target) -> with label, kind and color."""
    kind = F.coalesce(_kind(F.col("predicate"), EDGE_PARTS), F.lit("default"))
    color = F.create_map(*(F.lit(x) for pair in EDGE_COLORS.items() for x in pair))
    return edges.select("source", "predicate", "target", _short(F.col("predicate")).alias("label"), kind.alias("kind"), F.get(F.map_values(F.map_filter(color, lambda k, _: k == kind)), F.lit(0)).alias("color"))


def node_rows(nodes: DataFrame, layer: str = "default") -> DataFrame:
    """(iri, types) -> with layer and type: the layer of the first telling type."""
    telling = F.get(F.filter(F.transform("types", lambda t: _kind(t, TYPE_PARTS)), lambda x: x.isNotNull()), F.lit(0))
    return nodes.select("iri", "types", F.coalesce(telling, F.lit(layer)).alias("layer"), F.coalesce(_short(F.get("types", F.lit(0))), F.lit("default")).alias("type"))


def presets(vocabulary: str) -> dict[str, dict[str, str]]:
    """Queries for the explorer, by title: description and CONSTRUCT."""
    head = f"PREFIX cga: <{vocabulary}> PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> PREFIX sh: <{SH}> PREFIX prov: <http://www.w3.org/ns/prov#> PREFIX skos: <http://www.w3.org/2004/02/skos/core#> "
    portal = "?portal a cga:TransformPortal ; cga:sourceHolon ?src ; cga:targetHolon ?tgt . "

    def optional(subject: str, links: dict[str, str]) -> tuple[str, str]:
        """Template and pattern of links that may be missing."""
        triples = [f"{subject} {p} {o} ." for p, o in links.items()]
        return " ".join(triples), " ".join(f"OPTIONAL {{ {t} }}" for t in triples)

    unit, label = optional("?holon", {"rdfs:label": "?label", "cga:memberOf": "?parent"}), optional("?portal", {"rdfs:label": "?plabel"})
    limits = optional("?prop", {"sh:datatype": "?dt", "sh:minCount": "?min", "sh:maxCount": "?max", "sh:severity": "?sev", "sh:message": "?msg"})
    activity = optional("?activity", {"rdfs:label": "?label", "prov:wasAssociatedWith": "?agent", "prov:used": "?input"})
    made = "?activity prov:generated ?output ."
    queries = {
        "Holarchy Structure": ("Units, what contains them, and portals.", f"?holon a cga:Holon . {unit[0]} {portal}{label[0]}", f"{{ ?holon a cga:Holon . {unit[1]} }} UNION {{ {portal}{label[1]} }}"),
        "SHACL Shapes": ("Shapes and what they ask of properties.", f"?shape a sh:NodeShape ; sh:targetClass ?cls ; sh:property ?prop . ?prop sh:path ?path . {limits[0]}", f"?shape a sh:NodeShape . OPTIONAL {{ ?shape sh:targetClass ?cls }} OPTIONAL {{ ?shape sh:property ?prop . ?prop sh:path ?path . {limits[1]} }}"),
        "Portal Network": ("Portals with source and target.", portal + label[0], portal + label[1]),
        "Provenance Trail": ("Activities, their agents, inputs and outputs.", f"?activity a prov:Activity . {activity[0]} {made} ?output prov:wasDerivedFrom ?source .", f"?activity a prov:Activity . {activity[1]} OPTIONAL {{ {made} OPTIONAL {{ ?output prov:wasDerivedFrom ?source }} }}"),
        "Object Properties Only": ("Links between IRIs, without types.", "?s ?p ?o", "?s ?p ?o . FILTER(isIRI(?o)) FILTER(?p != rdf:type)"),
        "External Bindings": ("Links to the world outside.", "?holon cga:bindsTo ?ext . ?holon skos:exactMatch ?match .", "{ ?holon cga:bindsTo ?ext } UNION { ?holon skos:exactMatch ?match }"),
    }
    return {title: {"description": text, "query": f"{head}CONSTRUCT {{ {template} }} WHERE {{ {where} }}"} for title, (text, template, where) in queries.items()}
