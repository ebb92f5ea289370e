"""The dataset facade: governed units (holons) with layers of named graphs, portals between them, validation, provenance,
metadata, scope resolution, projections. Catalog lookups read the small registry; everything over data is a plan."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict, deque
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import PROV, RDF, RDFS, SH, TYPE, check_iri, decode, iri, literal

from trellis.model import AuditTrail, ClassInstanceCount, GraphMetadata, HolarchySummary, HolarchyTree, HolonDetail, HolonInfo, HolonSummary, MembraneBreachError, MembraneHealth, MembraneResult, NeighborhoodEdge, NeighborhoodGraph, NeighborhoodNode, PortalDetail, PortalInfo, PortalSummary, ProjectionPipelineSpec, ProjectionPipelineStep, ProjectionPipelineSummary, SealedPortalError, ShapeViolation, SurfaceReport, TraversalRecord, ValidationRecord, parse_time
from trellis.operators import projection, rdfs, shacl
from trellis.operators.distinct import once
from trellis.operators.scope import ScopeResolver
from trellis.operators.store import Graph, SparkStore

#: The vocabulary's namespace; a parameter of the dataset, so that data written under another one stays readable.
VOCABULARY = "urn:holarchy:ontology:"
REGISTRY = "urn:holarchy:registry"
ROLES = {"interior": "hasInterior", "boundary": "hasBoundary", "projection": "hasProjection", "context": "hasContext"}
PREFIXES = f"@prefix rdf: <{RDF}> . @prefix rdfs: <{RDFS}> . @prefix sh: <{SH}> . @prefix xsd: <{T.XSD}> . @prefix prov: <{PROV}> .\n"
KEEP = object()
LABEL = f"<{RDFS}label>"
MAX_DEPTH = 100


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _time(text: str) -> str:
    return f'"{text}"^^<{T.XSD}dateTime>'


class GraphDataset:
    def __init__(self, store: SparkStore | SparkSession, registry_iri: str = REGISTRY, load_ontology: bool = True, metadata_updates: str = "eager", vocabulary: str = VOCABULARY):
        if metadata_updates not in ("eager", "off"):
            raise ValueError("metadata_updates must be 'eager' or 'off'")
        self.store = SparkStore(store) if isinstance(store, SparkSession) else store
        self.registry, self.metadata_updates, self.vocabulary = check_iri(registry_iri), metadata_updates, vocabulary
        self._batch, self._typed = 0, False
        self._traversal_hooks, self._validation_hooks = [], []
        if load_ontology:
            from trellis.ontology import ontology, shapes

            self.store.parse_into(vocabulary.rstrip(":") + ":graph", ontology(vocabulary))
            self.store.parse_into(vocabulary.rstrip(":") + ":shapes", shapes(vocabulary, self.registry))

    # small helpers
    def cga(self, name: str) -> str:
        return f"<{self.vocabulary}{name}>"

    def _add(self, *triples, graph: str | None = None) -> None:
        self.store.post_graph(graph or self.registry, triples)

    def _reg(self, s=None, p=None, o=None) -> list[tuple]:
        return [q[1:] for q in self.store.rows(self.registry, s, p, o)]

    def _first(self, s, p, graph=None):
        return next((decode(q[3]) for q in self.store.rows(graph or self.registry, s, p)), None)

    def prefixed(self, ttl: str) -> str:
        return PREFIXES + f"@prefix cga: <{self.vocabulary}> .\n" + ttl

    @property
    def quads(self) -> DataFrame:
        return self.store.quads

    def query(self, sparql: str, **bindings):
        return self.store.query(sparql, **bindings)

    def construct(self, sparql: str, **bindings) -> Graph:
        return self.store.construct(sparql, **bindings)

    def ask(self, sparql: str, **bindings) -> bool:
        return self.store.ask(sparql, **bindings)

    def update(self, sparql: str) -> None:
        self.store.update(sparql)

    def frame(self, sparql: str, **bindings) -> DataFrame:
        return self.store.frame(sparql, **bindings)

    # holons
    def add_holon(self, holon_iri: str, label: str | None = None, member_of: str | None = None, holon_type: str | None = None) -> str:
        h = iri(check_iri(holon_iri))
        out = [(h, TYPE, self.cga("Holon"))]
        if label is not None:
            out.append((h, LABEL, literal(label)))
        if member_of:
            out.append((h, self.cga("memberOf"), iri(check_iri(member_of))))
        if holon_type:
            out.append((h, TYPE, self._class(holon_type)))
        self._add(*out)
        return holon_iri

    def _class(self, name: str) -> str:
        """A full IRI, cga:Name, or a bare name of the vocabulary."""
        if name.startswith("cga:"):
            return self.cga(name[4:])
        return iri(check_iri(name)) if ":" in name else self.cga(name)

    def _layer(self, holon: str, role: str, graph: str) -> None:
        self._add((iri(holon), self.cga(ROLES[role]), iri(graph)), (iri(graph), TYPE, self.cga("HolonicGraph")), (iri(graph), self.cga("graphRole"), self.cga(role.capitalize() + "Role")))

    def _add_layer(self, role: str, holon: str, ttl: str, graph: str | None, format: str) -> str:
        graph = check_iri(graph or f"{check_iri(holon)}/{role}")
        self.store.parse_into(graph, self.prefixed(ttl) if format in ("turtle", "trig", "n3") else ttl, format)
        self._layer(holon, role, graph)
        self._refresh_eager(graph, holon)
        return graph

    def add_interior(self, holon_iri, ttl, graph_iri=None, format="turtle"):
        return self._add_layer("interior", holon_iri, ttl, graph_iri, format)

    def add_boundary(self, holon_iri, ttl, graph_iri=None, format="turtle"):
        return self._add_layer("boundary", holon_iri, ttl, graph_iri, format)

    def add_projection(self, holon_iri, ttl, graph_iri=None, format="turtle"):
        return self._add_layer("projection", holon_iri, ttl, graph_iri, format)

    def add_context(self, holon_iri, ttl, graph_iri=None, format="turtle"):
        return self._add_layer("context", holon_iri, ttl, graph_iri, format)

    def add_layer_frame(self, role: str, holon_iri: str, triples: DataFrame, graph_iri: str | None = None) -> str:
        """A layer of any size from a DataFrame (s, p, o)."""
        graph = check_iri(graph_iri or f"{check_iri(holon_iri)}/{role}")
        self.store.load(triples.select(F.lit(iri(graph)).alias("g"), "s", "p", "o"))
        self._layer(holon_iri, role, graph)
        self._refresh_eager(graph, holon_iri)
        return graph

    def layers(self, holon: str, role: str) -> list[str]:
        return sorted(decode(o) for _, _, o in self._reg(iri(holon), self.cga(ROLES[role])))

    def _holons(self) -> list[str]:
        return sorted({decode(s) for s, _, _ in self._reg(None, TYPE, self.cga("Holon"))})

    def list_holons(self, limit: int | None = None, offset: int = 0) -> list[HolonInfo]:
        labels = {s: decode(o) for s, _, o in self._reg(None, LABEL)}
        found = defaultdict(lambda: defaultdict(list))
        for role, p in ROLES.items():
            for s, _, o in self._reg(None, self.cga(p)):
                found[s][role].append(decode(o))
        every = sorted(self._holons(), key=lambda h: (labels.get(iri(h)) or "", h))
        every = every[offset : None if limit is None else offset + limit]
        return [HolonInfo(h, labels.get(iri(h)), *(sorted(found[iri(h)][r]) for r in ROLES)) for h in every]

    def iter_holons(self, limit=None, offset=0):
        yield from self.list_holons(limit, offset)

    def get_holon(self, holon_iri: str) -> HolonInfo | None:
        if not self._reg(iri(holon_iri), TYPE, self.cga("Holon")):
            return None
        return HolonInfo(holon_iri, self._first(iri(holon_iri), LABEL), *(self.layers(holon_iri, r) for r in ROLES))

    def remove_holon(self, holon_iri: str) -> bool:
        if self.get_holon(holon_iri) is None:
            return False
        h = iri(holon_iri)
        for p in [*self.find_portals_from(holon_iri), *self.find_portals_to(holon_iri)]:
            self.remove_portal(p.iri)
        for role in ROLES:
            for g in self.layers(holon_iri, role):
                self.store.delete_graph(g)
                records = {s for s, _, _ in self._reg(None, self.cga("inGraph"), iri(g))}
                self.store.remove([(self.registry, *t) for s in {iri(g), *records} for t in self._reg(s)])
        self.store.remove([(self.registry, *t) for t in [*self._reg(h), *self._reg(None, self.cga("memberOf"), h)]])
        self._refresh_eager(self.registry)
        return True

    @contextmanager
    def batch(self):
        """Defers metadata to the end; nothing is refreshed after an exception."""
        self._batch += 1
        try:
            yield self
        except BaseException:
            self._batch -= 1
            raise
        self._batch -= 1
        if not self._batch:
            self._refresh_eager(self.registry)

    def bulk_load(self, holons=(), portals=()) -> tuple[int, int]:
        """holons: dicts of add_holon arguments, with interior, boundary, projection, context texts; portals: dicts of add_portal arguments."""
        n = m = 0
        with self.batch():
            for h in holons:
                h = dict(h)
                layers = {r: h.pop(r) for r in ROLES if r in h}
                name = h.pop("iri", None) or h.pop("holon_iri")
                self.add_holon(name, **h)
                for role, texts in layers.items():
                    for k, ttl in enumerate([texts] if isinstance(texts, str) else texts):
                        self._add_layer(role, name, ttl, f"{name}/{role}" + (f"/{k}" if k else ""), "turtle")
                n += 1
            for p in portals:
                p = dict(p)
                self.add_portal(p.pop("iri", None) or p.pop("portal_iri"), p.pop("source", None) or p.pop("source_iri"), p.pop("target", None) or p.pop("target_iri"), **p)
                m += 1
        return n, m

    def compose(self, iris, layers=("interior",)) -> Graph:
        return Graph(t for h in iris for r in layers if r in ROLES for g in self.layers(h, r) for t in self.store.get_graph(g))

    def _frame(self, graphs) -> DataFrame:
        """The distinct triples of some graphs."""
        return once(self.quads.where(F.col("g").isin([iri(g) for g in graphs])).select("s", "p", "o"))

    def list_holons_summary(self) -> list[HolonSummary]:
        return [self._summary(h) for h in self._holons()]

    def _summary(self, h: str, cls=HolonSummary):
        kinds = sorted(o for _, _, o in self._reg(iri(h), TYPE) if o != self.cga("Holon"))
        return cls(h, self._first(iri(h), LABEL), decode(kinds[0]) if kinds else None, self._first(iri(h), self.cga("dataClassification")), self._first(iri(h), self.cga("memberOf")), self._first(iri(h), self.cga("membraneHealth")), self._first(iri(h), self.cga("interiorTripleCount")), _iso(self._first(iri(h), self.cga("holonLastModified"))))

    def get_holon_detail(self, holon_iri: str) -> HolonDetail | None:
        info = self.get_holon(holon_iri)
        if info is None:
            return None
        d = self._summary(holon_iri, HolonDetail)
        d.interior_graphs, d.boundary_graphs, d.projection_graphs, d.context_graphs = info.interior_graphs, info.boundary_graphs, info.projection_graphs, info.context_graphs
        d.interior_triple_count = self.quads.where(F.col("g").isin([iri(g) for g in info.interior_graphs])).count()
        for g in [g for r in ROLES for g in self.layers(holon_iri, r)]:
            if m := self.get_graph_metadata(g):
                d.layer_metadata[g] = m
        d.holon_last_modified = max((m.last_modified for m in d.layer_metadata.values() if m.last_modified), default=None)
        return d

    def holon_interior_classes(self, holon_iri: str) -> list[ClassInstanceCount]:
        typed = self.quads.where(F.col("g").isin([iri(g) for g in self.layers(holon_iri, "interior")]) & (F.col("p") == TYPE))
        found = [ClassInstanceCount(decode(r.o), r.n) for r in typed.groupBy("o").agg(F.count_distinct("s").alias("n")).collect()]
        return sorted(found, key=lambda c: (-c.count, c.class_iri))

    def compute_depth(self, holon: str | None = None) -> HolarchyTree:
        parents: dict = {h: None for h in self._holons()}
        if holon:
            parents.setdefault(holon, None)
        for s, _, o in self._reg(None, self.cga("memberOf")):
            parents[decode(s)] = decode(o)
        for p in list(parents.values()):
            if p:
                parents.setdefault(p, None)
        depths, children = {}, defaultdict(list)
        for h in parents:
            seen, at, d = {h}, parents[h], 0
            while at and at not in seen:
                seen.add(at)
                at, d = parents.get(at), d + 1
            depths[h] = d
            if parents[h]:
                children[parents[h]].append(h)
        return HolarchyTree(depths, parents, {k: sorted(v) for k, v in children.items()}, {decode(s): decode(o) for s, _, o in self._reg(None, LABEL)})

    def summary(self) -> str:
        rows = [f"{len(self._holons())} holons, {len(self.list_portals())} portals, {len(self.store.list_named_graphs())} graphs"]
        for h in self.list_holons():
            rows.append(f"  {h.label or h.iri}: {len(h.interior_graphs)} interior, {len(h.boundary_graphs)} boundary, {len(h.projection_graphs)} projection, {len(h.context_graphs)} context")
        return "\n".join(rows)

    def __repr__(self) -> str:
        return f"GraphDataset({len(self._holons())} holons, {len(self.list_portals())} portals)"

    def holarchy_summary(self, max_age: timedelta = timedelta(hours=1), recent_limit: int = 10) -> HolarchySummary:
        results = self.validate_all()
        counts = {h.value: sum(r.health == h for r in results.values()) for h in MembraneHealth}
        tree = self.compute_depth()
        roots = [h for h in self._holons() if not tree.parents.get(h)]
        return HolarchySummary(len(self._holons()), len(self.list_portals()), roots, counts, len(self.stale_holons(max_age)), self.collect_audit_trail(limit=recent_limit).traversals)

    # portals
    def add_portal(self, portal_iri, source_iri, target_iri, construct_query=None, portal_type="TransformPortal", extra_ttl=None, label=None, graph_iri=None) -> str:
        p, s, t = (iri(check_iri(x)) for x in (portal_iri, source_iri, target_iri))
        if label is None:
            label = f"{self._first(s, LABEL) or source_iri} -> {self._first(t, LABEL) or target_iri}"
        block = [(p, TYPE, self.cga("Portal")), (p, self.cga("sourceHolon"), s), (p, self.cga("targetHolon"), t), (p, LABEL, literal(label))]
        if portal_type:
            block.append((p, TYPE, self._class(portal_type)))
        if construct_query:
            block.append((p, self.cga("constructQuery"), literal(construct_query)))
        if extra_ttl:
            heads = "\n".join(re.findall(r"(?m)^\s*@prefix[^\n]*", extra_ttl))
            body = re.sub(r"(?m)^\s*@prefix[^\n]*", "", extra_ttl).strip()
            body = body if body.startswith(("<", "[")) or re.match(r"\w*:", body) and not re.match(r"(?:cga|rdfs?|prov|sh):\S+\s+[^.;]*[.;]?\s*$", body) else f"{p} {body}"
            block += list(Graph.parse(self.prefixed(f"{heads}\n{body.rstrip().rstrip('.;')} .")))
        for g in (graph_iri or f"{source_iri}/boundary", self.registry):
            self._add(*block, graph=g)
        return portal_iri

    def remove_portal(self, portal_iri: str) -> bool:
        return bool(self.store.remove(self.store.rows(None, iri(portal_iri))))

    def update_portal(self, portal_iri, construct_query=KEEP, label=KEEP, portal_type=KEEP) -> None:
        """KEEP leaves a property, None removes it. All graphs that hold the portal are changed alike."""
        p = iri(portal_iri)
        graphs = {q[0] for q in self.store.rows(None, p, self.cga("sourceHolon"))}
        if not graphs:
            raise ValueError(f"no portal {portal_iri}")
        for value, predicate in ((construct_query, self.cga("constructQuery")), (label, LABEL)):
            if value is not KEEP:
                self.store.remove([q for g in graphs for q in self.store.rows(g, p, predicate)])
                if value is not None:
                    for g in graphs:
                        self._add((p, predicate, literal(value)), graph=g)
        if portal_type is not KEEP:
            self.store.remove([q for g in graphs for q in self.store.rows(g, p, TYPE) if q[3] != self.cga("Portal")])
            if portal_type:
                for g in graphs:
                    self._add((p, TYPE, self._class(portal_type)), graph=g)

    def _portals(self, source=None, target=None, portal=None) -> list[PortalInfo]:
        """Merged by portal over all graphs that declare it, in order of IRI."""
        found: dict = defaultdict(lambda: defaultdict(set))
        wanted = {q[1] for q in self.store.rows(None, iri(portal) if portal else None, self.cga("sourceHolon"), iri(source) if source else None)}
        if target:
            wanted &= {q[1] for q in self.store.rows(None, None, self.cga("targetHolon"), iri(target))}
        for p in (self.cga("sourceHolon"), self.cga("targetHolon"), self.cga("constructQuery"), LABEL, TYPE):
            for _, s, _, o in self.store.rows(None, iri(portal) if portal else None, p):
                if s in wanted:
                    found[s][p].add(o)
        out = []
        for s, ps in sorted(found.items()):
            one = lambda p: decode(min(ps[p])) if ps[p] else None  # noqa: B023, E731
            kinds = sorted(ps[TYPE] - {self.cga("Portal")})
            if ps[self.cga("targetHolon")]:
                out.append(PortalInfo(decode(s), one(self.cga("sourceHolon")), one(self.cga("targetHolon")), one(LABEL), one(self.cga("constructQuery")), decode(kinds[0]) if kinds else None))
        return out

    def find_portals_from(self, holon_iri, limit=None, offset=0) -> list[PortalInfo]:
        return self._portals(source=holon_iri)[offset : None if limit is None else offset + limit]

    def find_portals_to(self, holon_iri, limit=None, offset=0) -> list[PortalInfo]:
        return self._portals(target=holon_iri)[offset : None if limit is None else offset + limit]

    def iter_portals_from(self, holon_iri, limit=None, offset=0):
        yield from self.find_portals_from(holon_iri, limit, offset)

    def iter_portals_to(self, holon_iri, limit=None, offset=0):
        yield from self.find_portals_to(holon_iri, limit, offset)

    def find_portal(self, source_iri, target_iri) -> PortalInfo | None:
        return next(iter(self._portals(source_iri, target_iri)), None)

    def list_portals(self) -> list[PortalSummary]:
        return [PortalSummary(p.iri, p.source_iri, p.target_iri, p.label, p.portal_type) for p in self._portals()]

    def get_portal(self, portal_iri) -> PortalDetail | None:
        return next((PortalDetail(p.iri, p.source_iri, p.target_iri, p.label, p.portal_type, p.construct_query) for p in self._portals(portal=portal_iri)), None)

    def portal_traversal_history(self, portal_iri, limit: int = 50) -> list[TraversalRecord]:
        p = self.get_portal(portal_iri)
        if p is None:
            return []
        every = [t for t in self._traversals() if (t.source_iri, t.target_iri) == (p.source_iri, p.target_iri)]
        return every[: min(max(limit, 1), 10_000)]

    def find_path(self, source_iri, target_iri) -> list[PortalInfo] | None:
        """The shortest chain of portals; ties by portal IRI. None from a unit to itself unless a cycle leads back."""
        out = defaultdict(list)
        for p in self._portals():
            out[p.source_iri].append(PortalInfo(p.iri, p.source_iri, p.target_iri, p.label, None, p.portal_type))
        seen, queue = {source_iri}, deque([(source_iri, [])])
        while queue:
            at, chain = queue.popleft()
            for p in out[at]:
                if p.target_iri == target_iri:
                    return [*chain, p]
                if p.target_iri not in seen:
                    seen.add(p.target_iri)
                    queue.append((p.target_iri, [*chain, p]))
        return None

    def holon_neighborhood(self, holon_iri, depth: int = 1) -> NeighborhoodGraph:
        if depth < 0:
            raise ValueError("depth must not be negative")
        touching = defaultdict(list)
        for p in self._portals():
            for x in {p.source_iri, p.target_iri}:
                touching[x].append(p)
        depths, edges, level = {holon_iri: 0}, {}, [holon_iri]
        for d in range(1, min(depth, MAX_DEPTH) + 1):
            following = []
            for h in level:
                for p in touching[h]:
                    edges.setdefault(p.iri, p)
                    for x in (p.source_iri, p.target_iri):
                        if x not in depths:
                            depths[x] = d
                            following.append(x)
            level = following
        known = set(self._holons())
        nodes = [NeighborhoodNode(h, self._first(iri(h), LABEL), (self._summary(h).kind or self.vocabulary + "Holon") if h in known else None, d) for h, d in sorted(depths.items())]
        return NeighborhoodGraph(holon_iri, depth, nodes, [NeighborhoodEdge(f"edge-{k + 1:04d}", p.source_iri, p.target_iri, p.iri, p.label, p.portal_type) for k, p in enumerate(edges.values())])

    def resolve(self, predicate, from_holon, max_depth: int = 3, order: str = "network", limit: int = 50):
        return ScopeResolver(self).resolve(predicate, from_holon, max_depth, order, limit)

    # traversal
    def traverse_portal(self, portal_iri, inject_into=None, source_only: bool = False) -> Graph:
        p = iri(portal_iri)
        kinds = {q[3] for q in self.store.rows(None, p, TYPE)}
        if self.cga("SealedPortal") in kinds:
            raise SealedPortalError(portal_iri)
        portal = self.get_portal(portal_iri)
        if portal is None or not portal.construct_query:
            raise ValueError(f"portal {portal_iri} carries no query to run")
        out = self.store.construct(portal.construct_query, self._scope(portal, source_only))
        if inject_into:
            self.store.post_graph(inject_into, out)
            self._refresh_eager(inject_into)
        return out

    def _scope(self, portal, source_only: bool = False) -> DataFrame:
        """The quads that a portal's query sees; their graph names stay."""
        layer = next((q[3] for q in self.store.rows(None, iri(portal.iri), self.cga("sourceLayer"))), None)
        projections = self.layers(portal.source_iri, "projection")
        if layer == self.cga("ProjectionRole") or layer is None and projections:
            return self.quads.where(F.col("g").isin([iri(g) for g in projections]))
        if source_only:
            return self.quads.where(F.col("g").isin([iri(g) for g in self.layers(portal.source_iri, "interior")]))
        return self.quads

    def _digest(self, triples) -> str:
        return hashlib.sha256("".join(f"{s} {p} {o} .\n" for s, p, o in sorted(triples)).encode()).hexdigest()

    def traverse(self, source_iri, target_iri, inject=True, validate=True, fail_on_breach=False, agent_iri=None):
        """(projected triples, membrane result or None)."""
        portal = self.find_portal(source_iri, target_iri)
        if portal is None:
            raise ValueError(f"no portal from {source_iri} to {target_iri}")
        graph = next(iter(self.layers(target_iri, "interior")), f"{target_iri}/interior")
        projected = self.traverse_portal(portal.iri)
        before, same = self.store.snapshot(), False
        if inject:
            if agent_iri:
                context = next(iter(self.layers(target_iri, "context")), f"{target_iri}/context")
                key, digest = (iri(target_iri), self.cga("lastProjectionHash")), self._digest(projected)
                mine = literal(f"{portal.iri} {digest}")
                had = [q for q in self.store.rows(context, *key) if decode(q[3]).startswith(f"{portal.iri} ")]
                same = any(q[3] == mine for q in had)
                if not same:
                    self.store.remove(had)
                    self._add((*key, mine), graph=context)
            if not same:
                self.store.post_graph(graph, projected)
                self._layer(target_iri, "interior", graph)
                self._refresh_eager(graph, target_iri)
        result = self.validate_membrane(target_iri) if validate else None
        if result and result.health == MembraneHealth.COMPROMISED and fail_on_breach:
            self.store.restore(before)
            raise MembraneBreachError(result)
        if agent_iri:
            self.record_traversal(source_iri, target_iri, agent_iri, f"{portal.label or portal.iri}" + (" (no change)" if same else ""))
            if result:
                self.record_validation(target_iri, result.health, agent_iri)
        for hook in self._traversal_hooks:
            hook(source_iri, target_iri, projected)
        return projected, result

    def traverse_path(self, source_iri, target_iri, **options) -> list:
        chain = self.find_path(source_iri, target_iri)
        if chain is None:
            raise ValueError(f"no path from {source_iri} to {target_iri}")
        return [self.traverse(p.source_iri, p.target_iri, **options) for p in chain]

    def dry_run(self, source_iri, target_iri):
        portal = self.find_portal(source_iri, target_iri)
        if portal is None:
            raise ValueError(f"no portal from {source_iri} to {target_iri}")
        projected = self.traverse_portal(portal.iri)
        more = self.store.spark.createDataFrame([tuple(t) for t in projected], "s string, p string, o string")
        return projected, self._validated(target_iri, once(self._frame(self.layers(target_iri, "interior")).unionByName(more)))

    def rollback_traversal(self, activity_iri) -> int:
        activity = self.get_activity(activity_iri)
        if not isinstance(activity, TraversalRecord):
            raise ValueError(f"no traversal {activity_iri}")
        portal = self.find_portal(activity.source_iri, activity.target_iri)
        if portal is None:
            raise ValueError("its portal is gone")
        gone = self.traverse_portal(portal.iri)
        graphs = self.layers(activity.target_iri, "interior")
        away = self.store.spark.createDataFrame([(*t, g) for g in graphs for t in map(tuple, gone)], "s string, p string, o string, name string")
        there = self.quads.join(away.withColumn("g", F.concat(F.lit("<"), "name", F.lit(">"))), ["g", "s", "p", "o"], "left_semi").collect()  # at most what goes
        n = self.store.remove([(r.g[1:-1], r.s, r.p, r.o) for r in there])
        for g in graphs:
            self._refresh_eager(g, activity.target_iri)
        return n

    def on_traversal(self, hook):
        self._traversal_hooks.append(hook)
        return hook

    def on_validation(self, hook):
        self._validation_hooks.append(hook)
        return hook

    # validation
    def _validated(self, holon_iri, data: DataFrame) -> MembraneResult:
        shapes = self._boundary(holon_iri)
        if not shapes:
            return MembraneResult(holon_iri, True, MembraneHealth.INTACT, "No boundary shapes defined.")
        return self._judged(holon_iri, shacl.validate(data, shapes, self.quads).collect())

    def _boundary(self, holon_iri) -> frozenset:
        shapes = frozenset(t for g in self.layers(holon_iri, "boundary") for t in self.store.get_graph(g))
        return shapes if any(t[1].startswith(f"<{SH}") for t in shapes) else frozenset()

    def _judged(self, holon_iri, report: list) -> MembraneResult:
        report = sorted(report, key=lambda r: str([r[x] for x in ("shape", "focus", "path", "value", "message", "severity", "component")]))
        violations, warnings, rows = [], [], []
        for r in report:
            kind = "Violation" if r.severity.endswith("Violation") else "Warning" if r.severity.endswith("Warning") else None
            if not kind:
                continue
            rows.append(ShapeViolation(decode(r["shape"]), decode(r["focus"]), r["path"], None if r["value"] is None else str(decode(r["value"])), r["message"], r["severity"]))
            (violations if kind == "Violation" else warnings).append(f"{kind}: {r['message']}; focus={decode(r['focus'])}; path={r['path']}")
        health = MembraneHealth.COMPROMISED if violations else MembraneHealth.WEAKENED if warnings else MembraneHealth.INTACT
        return MembraneResult(holon_iri, not rows, health, "\n".join([*violations, *warnings]) or "Conforms.", violations, warnings, rows)

    def validate_membrane(self, holon_iri) -> MembraneResult:
        result = self._validated(holon_iri, self._frame(self.layers(holon_iri, "interior")))
        for hook in self._validation_hooks:
            hook(holon_iri, result)
        return result

    def validate_all(self) -> dict[str, MembraneResult]:
        """Every unit against its boundary; units of one boundary are one plan, in which the unit is a key."""
        by, out = defaultdict(list), {}
        for h in self._holons():
            by[self._boundary(h)].append(h)
        for shapes, units in by.items():
            found = defaultdict(list)
            if shapes:
                graphs = self.store.spark.createDataFrame([(iri(g), h) for h in units for g in self.layers(h, "interior")], "g string, unit string")
                for r in shacl.validate(self.quads.join(graphs, "g").select("unit", "s", "p", "o"), shapes, self.quads).collect():
                    found[r.unit].append(r)
            out |= {h: self._judged(h, found[h]) if shapes else MembraneResult(h, True, MembraneHealth.INTACT, "No boundary shapes defined.") for h in units}
        for h in self._holons():
            for hook in self._validation_hooks:
                hook(h, out[h])
        return {h: out[h] for h in self._holons()}

    def surface_report(self, holon_iri, result: MembraneResult | None = None) -> SurfaceReport:
        out = SurfaceReport(holon_iri)
        for g in self.layers(holon_iri, "boundary"):
            sh = shacl.Shapes(self.store.get_graph(g))
            for shape in sh.targets():
                out.target_classes += [decode(c) for c in sh.all(shape, "targetClass") if decode(c) not in out.target_classes]
                for p in sh.all(shape, "property"):
                    path = (decode(sh.one(p, "path")) or "").rsplit(":", 1)[-1]
                    (out.required_fields if int(decode(sh.one(p, "minCount")) or 0) > 0 else out.optional_fields).append(path)
        if result:
            out.violations, out.warnings = result.violations, result.warnings
        return out

    # provenance
    def _context(self, holon_iri) -> str:
        graph = next(iter(self.layers(holon_iri, "context")), f"{holon_iri}/context")
        self._layer(holon_iri, "context", graph)
        return graph

    def record_traversal(self, source_iri, target_iri, agent_iri, label=None, timestamp=None) -> str:
        activity, graph = f"urn:prov:traversal:{uuid.uuid4().hex[:12]}", self._context(target_iri)
        a, s, t = iri(activity), iri(source_iri), iri(target_iri)
        self._add((a, TYPE, f"<{PROV}Activity>"), (a, f"<{PROV}used>", s), (a, f"<{PROV}generated>", t), (a, f"<{PROV}wasAssociatedWith>", iri(check_iri(agent_iri))), (a, f"<{PROV}startedAtTime>", _time(timestamp or now())), (a, LABEL, literal(label or f"{source_iri} -> {target_iri}")), (t, f"<{PROV}wasDerivedFrom>", s), graph=graph)
        return activity

    def record_validation(self, holon_iri, health, agent_iri=None, timestamp=None) -> str:
        activity, graph = f"urn:prov:validation:{uuid.uuid4().hex[:12]}", self._context(holon_iri)
        a, name = iri(activity), getattr(health, "value", health).lower()
        out = [(a, TYPE, f"<{PROV}Activity>"), (a, f"<{PROV}used>", iri(holon_iri)), (a, self.cga("membraneHealth"), self.cga(name.capitalize())), (a, f"<{PROV}endedAtTime>", _time(timestamp or now())), (a, LABEL, literal(f"validation: {name}"))]
        if agent_iri:
            out.append((a, f"<{PROV}wasAssociatedWith>", iri(check_iri(agent_iri))))
        self._add(*out, graph=graph)
        return activity

    def _activities(self) -> dict:
        found: dict = defaultdict(lambda: defaultdict(list))
        wanted = {(q[0], q[1]) for q in self.store.rows(None, None, TYPE, f"<{PROV}Activity>")}
        for p in (f"<{PROV}used>", f"<{PROV}generated>", f"<{PROV}wasAssociatedWith>", f"<{PROV}startedAtTime>", f"<{PROV}endedAtTime>", LABEL, self.cga("membraneHealth")):
            for g, s, _, o in self.store.rows(None, None, p):
                if (g, s) in wanted:
                    found[g, s][p].append(decode(o))
        return found

    def _traversals(self) -> list[TraversalRecord]:
        derived = {(q[0], decode(q[1]), decode(q[3])) for q in self.store.rows(None, None, f"<{PROV}wasDerivedFrom>")}
        out = {}
        for (g, a), ps in self._activities().items():
            one = lambda p: next(iter(ps.get(p, [])), None)  # noqa: B023, E731
            for s in ps.get(f"<{PROV}used>", []):
                for t in ps.get(f"<{PROV}generated>", []):
                    if (g, t, s) in derived:
                        out[a, s, t] = TraversalRecord(decode(a), s, t, one(f"<{PROV}wasAssociatedWith>"), one(LABEL), _iso(one(f"<{PROV}startedAtTime>")))
        return sorted(out.values(), key=lambda r: (r.timestamp or "", r.activity_iri), reverse=True)

    def _validations(self) -> list[ValidationRecord]:
        out = {}
        for (_, a), ps in self._activities().items():
            one = lambda p: next(iter(ps.get(p, [])), None)  # noqa: B023, E731
            health = one(self.cga("membraneHealth"))
            if health:
                for h in ps.get(f"<{PROV}used>", []):
                    out[a, h] = ValidationRecord(decode(a), h, health.removeprefix(self.vocabulary).lower(), one(f"<{PROV}wasAssociatedWith>"), one(LABEL), _iso(one(f"<{PROV}endedAtTime>")))
        return sorted(out.values(), key=lambda r: (r.timestamp or "", r.activity_iri), reverse=True)

    def collect_audit_trail(self, limit=None, offset=0, since=None, kind=None) -> AuditTrail:
        """limit and offset count traversals and validations separately; since is exclusive; kind: traversal, validation or None."""
        after = parse_time(since) if since else None

        def cut(rows):
            if after:
                rows = [r for r in rows if r.timestamp and parse_time(r.timestamp) > after]
            return rows[offset : None if limit is None else offset + limit]

        traversals = cut(self._traversals()) if kind in (None, "traversal") else []
        validations = cut(self._validations()) if kind in (None, "validation") else []
        derived = [(decode(q[1]), decode(q[3])) for q in self.store.rows(None, None, f"<{PROV}wasDerivedFrom>")]
        return AuditTrail(traversals, validations, derived, {h: self.surface_report(h) for h in sorted({x for t in traversals for x in (t.source_iri, t.target_iri)})})

    def get_activity(self, activity_iri):
        return next((r for r in [*self._traversals(), *self._validations()] if r.activity_iri == activity_iri), None)

    def last_traversal(self, holon_iri) -> TraversalRecord | None:
        return next((r for r in self._traversals() if r.target_iri == holon_iri), None)

    def freshness(self, holon_iri) -> timedelta | None:
        last = self.last_traversal(holon_iri)
        at = parse_time(last.timestamp) if last and last.timestamp else None
        return datetime.now(timezone.utc) - at if at else None

    def is_stale(self, holon_iri, max_age: timedelta = timedelta(hours=1)) -> bool:
        age = self.freshness(holon_iri)
        return age is None or age > max_age

    def stale_holons(self, max_age: timedelta = timedelta(hours=1)) -> list[str]:
        """One pass over the history for all units."""
        last: dict = {}
        for r in self._traversals():  # the last comes first
            last.setdefault(r.target_iri, parse_time(r.timestamp) if r.timestamp else None)
        at = datetime.now(timezone.utc)
        return [h for h in self._holons() if last.get(h) is None or at - last[h] > max_age]

    def derivation_chain(self, holon_iri) -> list[str]:
        out, seen, queue = [], {holon_iri}, deque([holon_iri])
        edges = defaultdict(list)
        for q in self.store.rows(None, None, f"<{PROV}wasDerivedFrom>"):
            edges[decode(q[1])].append(decode(q[3]))
        while queue:
            for x in sorted(set(edges[queue.popleft()])):
                if x not in seen:
                    seen.add(x)
                    out.append(x)
                    queue.append(x)
        return out

    # metadata
    def _refresh_eager(self, graph, holon=None) -> None:
        if self.metadata_updates == "eager" and not self._batch:
            self.refresh_graph(graph)
            if holon:
                self._rollup(holon)

    def refresh_graph(self, graph: str, counted: tuple | None = None) -> GraphMetadata:
        """counted: the graph's triples and instances by class, if they are known."""
        if hasattr(self.store, "refresh_graph_metadata"):
            return self.store.refresh_graph_metadata(graph, self.registry)
        if not self._typed:
            self._add((iri(self.registry), TYPE, self.cga("HolonicGraph")), (iri(self.registry), self.cga("graphRole"), self.cga("RegistryRole")))
            self._typed = True
        if counted is not None:
            total, classes = counted
        elif graph in self.store.base_names():  # one aggregate over the graph's quads
            of = self.quads.where(F.col("g") == iri(graph))
            total, classes = of.count(), {r[0]: r[1] for r in of.where(F.col("p") == TYPE).groupBy("o").count().collect()}
        else:
            rows = self.store.rows(graph)
            total, classes = len(rows), defaultdict(int)
            for _, _, p, o in rows:
                if p == TYPE:
                    classes[o] += 1
        g, at = iri(graph), _time(now())
        records = {s for s, _, _ in self._reg(None, self.cga("inGraph"), g)}
        old = [t for p in ("tripleCount", "lastModified", "refreshedAt") for t in self._reg(g, self.cga(p))]
        self.store.remove([(self.registry, *t) for t in [*old, *(t for r in records for t in self._reg(r))]])
        new = [(g, self.cga("tripleCount"), literal(total)), (g, self.cga("lastModified"), at), (g, self.cga("refreshedAt"), at)]
        for c, n in classes.items():
            name = decode(c)
            slug = re.sub(r"[^A-Za-z0-9_-]+", "-", projection.local_name(name)).strip("-") or "class"
            r = iri(f"{graph}/inventory/{slug}-{hashlib.sha1(name.encode()).hexdigest()[:8]}")
            new += [(r, TYPE, self.cga("ClassInstanceCount")), (r, self.cga("inGraph"), g), (r, self.cga("class"), c), (r, self.cga("count"), literal(n))]
        self._add(*new)
        return self.get_graph_metadata(graph)

    def _rollup(self, holon) -> None:
        h = iri(holon)
        self.store.remove([(self.registry, *t) for p in ("interiorTripleCount", "holonLastModified") for t in self._reg(h, self.cga(p))])
        counts = [self._first(iri(g), self.cga("tripleCount")) for g in self.layers(holon, "interior")]
        times = [o for r in ROLES for g in self.layers(holon, r) for _, _, o in self._reg(iri(g), self.cga("lastModified"))]
        self._add((h, self.cga("interiorTripleCount"), literal(sum(c for c in counts if c))), *([(h, self.cga("holonLastModified"), max(times))] if times else []))

    def refresh_metadata(self, holon_iri, counted: dict | None = None) -> None:
        for g in [g for r in ROLES for g in self.layers(holon_iri, r)]:
            self.refresh_graph(g, None if counted is None else counted.get(g, (0, {})))
        self._rollup(holon_iri)

    def refresh_all_metadata(self) -> int:
        """All layers' counts by one aggregate over the quads."""
        every = self._holons()
        layers = self.store.spark.createDataFrame([(iri(g),) for h in every for r in ROLES for g in self.layers(h, r)], "g string").distinct()
        counted: dict = {}
        for r in self.quads.join(layers, "g", "left_semi").groupBy("g", F.when(F.col("p") == TYPE, F.col("o")).alias("c")).agg(F.count("*").alias("n")).collect():
            total, classes = counted.get(r.g[1:-1], (0, {}))
            counted[r.g[1:-1]] = (total + r.n, classes | ({r.c: r.n} if r.c is not None else {}))
        for h in every:
            self.refresh_metadata(h, counted)
        return len(every)

    def get_graph_metadata(self, graph_iri) -> GraphMetadata | None:
        g = iri(graph_iri)
        count = self._first(g, self.cga("tripleCount"))
        if count is None:
            return None
        inventory = [ClassInstanceCount(self._first(s, self.cga("class")), self._first(s, self.cga("count"))) for s, _, _ in self._reg(None, self.cga("inGraph"), g)]
        inventory.sort(key=lambda c: (-c.count, c.class_iri))
        role = self._first(g, self.cga("graphRole"))
        return GraphMetadata(graph_iri, count, _iso(self._first(g, self.cga("lastModified"))), _iso(self._first(g, self.cga("refreshedAt"))), inventory, role)

    # projections
    def project_holon(self, holon_iri, store_as=None, **options):
        triples = self.compose([holon_iri])
        out = projection.project_to_lpg(triples, **options)
        if store_as:
            rows = [(iri(n.iri), TYPE, iri(t)) for n in out.nodes.values() for t in n.types]
            rows += [(iri(n.iri), LABEL, literal(n.label)) for n in out.nodes.values() if n.label]
            rows += [(iri(e.source) if not e.source.startswith("_:") else e.source, iri(e.predicate), iri(e.target)) for e in out.edges]
            self._store_projection(holon_iri, store_as, rows)
        return out

    def _store_projection(self, holon_iri, graph, triples) -> None:
        self.store.put_graph(check_iri(graph), triples)
        self._layer(holon_iri, "projection", graph)
        self._refresh_eager(graph, holon_iri)

    def project_holarchy(self, **options):
        names = (self.cga("memberOf"), self.cga("sourceHolon"), self.cga("targetHolon"))
        kept = {self.cga("Holon"), self.cga("Portal")}
        subjects = {s for s, _, o in self._reg(None, TYPE) if o in kept}
        return projection.project_to_lpg([t for t in self._reg() if t[0] in subjects and (t[1] in (TYPE, LABEL) or t[1] in names)], **options)

    def apply_pipeline(self, holon_iri, pipeline: projection.Pipeline, store_as=None) -> Graph:
        out = Graph(tuple(r) for r in pipeline.apply(self._frame(self.layers(holon_iri, "interior"))).select("s", "p", "o").distinct().collect())
        if store_as:
            self._store_projection(holon_iri, store_as, out)
        return out

    def register_pipeline(self, spec: ProjectionPipelineSpec) -> str:
        for step in spec.steps:
            if step.transform_name:
                projection.resolve_transform(step.transform_name)
        s, cells = iri(check_iri(spec.iri)), []
        out = [(s, TYPE, self.cga("ProjectionPipelineSpec")), (s, LABEL, literal(spec.name))]
        if spec.description:
            out.append((s, f"<{RDFS}comment>", literal(spec.description)))
        for k, step in enumerate(spec.steps):
            cell, node = iri(f"{spec.iri}/list/{k}"), iri(f"{spec.iri}/step/{k}")
            cells.append(cell)
            out += [(cell, f"<{RDF}first>", node), (node, TYPE, self.cga("ProjectionPipelineStep")), (node, self.cga("stepName"), literal(step.name))]
            if step.transform_name:
                out.append((node, self.cga("transformName"), literal(step.transform_name)))
            if step.construct_query:
                out.append((node, self.cga("constructQuery"), literal(step.construct_query)))
        out += [(c, f"<{RDF}rest>", n) for c, n in zip(cells, [*cells[1:], f"<{RDF}nil>"])]
        out.append((s, self.cga("hasStep"), cells[0] if cells else f"<{RDF}nil>"))
        self._add(*out)
        return spec.iri

    def register_pipeline_ttl(self, ttl: str) -> None:
        self.store.parse_into(self.registry, self.prefixed(ttl))

    def attach_pipeline(self, holon_iri, spec_iri) -> None:
        self._add((iri(check_iri(holon_iri)), self.cga("hasPipeline"), iri(check_iri(spec_iri))))

    def _walk(self, head: str) -> list[str]:
        out, seen = [], set()
        while head and head != f"<{RDF}nil>" and head not in seen:
            seen.add(head)
            first = self._reg(head, f"<{RDF}first>")
            if not first:
                break
            out.append(first[0][2])
            rest = self._reg(head, f"<{RDF}rest>")
            head = rest[0][2] if rest else None
        return out

    def get_pipeline(self, spec_iri) -> ProjectionPipelineSpec | None:
        s = iri(spec_iri)
        if not self._reg(s, TYPE, self.cga("ProjectionPipelineSpec")):
            return None
        head = self._reg(s, self.cga("hasStep"))
        steps = [ProjectionPipelineStep(self._first(n, self.cga("stepName")), self._first(n, self.cga("transformName")), self._first(n, self.cga("constructQuery"))) for n in (self._walk(head[0][2]) if head else [])]
        return ProjectionPipelineSpec(spec_iri, self._first(s, LABEL), steps, self._first(s, f"<{RDFS}comment>"))

    def list_pipelines(self, holon_iri=None) -> list[ProjectionPipelineSummary]:
        if holon_iri:
            names = [decode(o) for _, _, o in self._reg(iri(holon_iri), self.cga("hasPipeline"))]
        else:
            names = [decode(s) for s, _, _ in self._reg(None, TYPE, self.cga("ProjectionPipelineSpec"))]
        specs = [p for p in map(self.get_pipeline, names) if p]
        return [ProjectionPipelineSummary(p.iri, p.name, len(p.steps), p.description) for p in sorted(specs, key=lambda p: (p.name or "", p.iri))]

    def run_projection(self, holon_iri, spec_iri, store_as=None, agent_iri=None) -> Graph:
        spec = self.get_pipeline(getattr(spec_iri, "iri", spec_iri))
        if spec is None:
            raise ValueError(f"no pipeline {spec_iri}")
        started, versions, pipeline = now(), [], projection.Pipeline(spec.name)
        for step in spec.steps:
            if step.transform_name:
                pipeline.add(step.name, projection.resolve_transform(step.transform_name))
                versions.append(f"{step.transform_name} {projection.transform_version(step.transform_name)}")
            if step.construct_query:
                pipeline.add(step.name, step.construct_query)
        out = self.apply_pipeline(holon_iri, pipeline, store_as)
        a, graph, host = iri(f"urn:activity:projection:{uuid.uuid4()}"), self._context(holon_iri), projection.host_metadata()
        rows = [(a, TYPE, f"<{PROV}Activity>"), (a, f"<{PROV}used>", iri(spec.iri)), (a, f"<{PROV}startedAtTime>", _time(started)), (a, f"<{PROV}endedAtTime>", _time(now())), (a, self.cga("runHost"), literal(host["host"])), (a, self.cga("runPlatform"), literal(host["platform"])), (a, self.cga("runPythonVersion"), literal(host["python"])), *[(a, self.cga("transformVersion"), literal(v)) for v in versions]]
        if store_as:
            rows.append((a, f"<{PROV}generated>", iri(store_as)))
        if agent_iri:
            rows.append((a, f"<{PROV}wasAssociatedWith>", iri(check_iri(agent_iri))))
        self._add(*rows, graph=graph)
        return out

    def materialize_rdfs(self, holon_iri, alignment_iris=None) -> str:
        target = f"{holon_iri}/interior/inferred"
        own = [g for g in self.layers(holon_iri, "interior") if g != target]
        more = [g for a in alignment_iris or () for g in self.layers(a, "interior")]
        given = self._frame(own)
        delta = rdfs.inferred(self._frame([*own, *more]), given)
        self.store.put_graph(target, [tuple(r) for r in delta.collect()])
        self._layer(holon_iri, "interior", target)
        return target

    # files and migration
    def export_graph(self, graph_iri, format="turtle") -> str:
        return self.store.export_graph(graph_iri, format)

    def export(self, format="trig") -> str:
        return self.store.export(format)

    def untyped_layers(self) -> list[tuple]:
        """The triples that layers lack: their typing as graphs and their roles."""
        have = set(self._reg(None, TYPE)) | set(self._reg(None, self.cga("graphRole")))
        wanted = {t for r, p in ROLES.items() for _, _, g in self._reg(None, self.cga(p)) for t in ((g, TYPE, self.cga("HolonicGraph")), (g, self.cga("graphRole"), self.cga(r.capitalize() + "Role")))}
        wanted |= {(iri(self.registry), TYPE, self.cga("HolonicGraph")), (iri(self.registry), self.cga("graphRole"), self.cga("RegistryRole"))}
        return sorted(wanted - have)

    def migrate_registry(self, apply: bool = False) -> list[tuple]:
        plan = self.untyped_layers()
        if apply:
            self._add(*plan)
        return plan


def _iso(v) -> str | None:
    return v.isoformat() if isinstance(v, datetime) else v
