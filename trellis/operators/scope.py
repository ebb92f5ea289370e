"""Scope resolution: breadth first from a unit over portals or containment, testing each unit once, nearest first."""

from __future__ import annotations

from collections import defaultdict, deque
from typing import Any, Protocol

from trellis.functions.terms import TYPE, decode, iri
from trellis.model import ResolveMatch

ORDERS = ("network", "reverse-network", "containment")


class Predicate(Protocol):
    def matches(self, dataset: Any, holon_iri: str) -> bool: ...
    def evidence(self) -> str: ...


class HasClassInInterior:
    """The registry's inventory lists the class in an interior, or an interior has a direct instance."""

    def __init__(self, class_iri: str):
        self.class_iri = class_iri
        self._found: tuple = (None, None)

    def matches(self, ds, holon_iri: str) -> bool:
        for g in ds.layers(holon_iri, "interior"):
            for s, _, _ in ds._reg(None, ds.cga("inGraph"), iri(g)):
                if ds._reg(s, ds.cga("class"), iri(self.class_iri)) and (ds._first(s, ds.cga("count")) or 0) > 0:
                    return True
            if g in self._graphs(ds):
                return True
        return False

    def _graphs(self, ds) -> set:
        """Read once for a state of the data."""
        if self._found[0] is not ds.quads:
            self._found = (ds.quads, ds.store.graphs_with(TYPE, iri(self.class_iri)))
        return self._found[1]

    def evidence(self) -> str:
        return f"interior has instances of {self.class_iri}"


class CustomSPARQL:
    """An ASK with {holon_iri} and {registry_iri} to fill in."""

    def __init__(self, ask_template: str):
        self.template = ask_template

    def matches(self, ds, holon_iri: str) -> bool:
        return ds.ask(self.template.replace("{holon_iri}", holon_iri).replace("{registry_iri}", ds.registry))

    def evidence(self) -> str:
        line = self.template.strip().split("\n")[0]
        return line if len(line) <= 80 else line[:80] + "..."


class ScopeResolver:
    def __init__(self, dataset):
        self.ds = dataset

    def resolve(self, predicate, from_holon: str, max_depth: int = 3, order: str = "network", limit: int = 50) -> list[ResolveMatch]:
        max_depth, limit = min(max(max_depth, 0), 100), min(max(limit, 1), 10_000)
        out, seen, queue, neighbors = [], {from_holon}, deque([(from_holon, 0)]), None
        while queue and len(out) < limit:
            at, depth = queue.popleft()
            if predicate.matches(self.ds, at):
                out.append(ResolveMatch(at, depth, predicate.evidence()))
            if depth < max_depth:
                neighbors = neighbors or self._neighbors(order)
                for x in neighbors(at):
                    if x not in seen:
                        seen.add(x)
                        queue.append((x, depth + 1))
        return out

    def _neighbors(self, order: str):
        ahead, back, near = defaultdict(set), defaultdict(set), defaultdict(set)
        if order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")
        if order == "containment":
            for s, _, o in self.ds._reg(None, self.ds.cga("memberOf")):
                near[decode(s)].add(decode(o))
                near[decode(o)].add(decode(s))
            return lambda x: sorted(near[x])
        for p in self.ds._portals():
            ahead[p.source_iri].add(p.target_iri)
            back[p.target_iri].add(p.source_iri)
        if order == "reverse-network":
            return lambda x: sorted(back[x])
        return lambda x: list(dict.fromkeys([*sorted(ahead[x]), *sorted(back[x])]))
