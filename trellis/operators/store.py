"""The quad store: a bulk DataFrame of quads and small graphs on the driver, both behind one immutable-snapshot interface."""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod
from collections.abc import Iterable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.terms import decode, iri, literal
from trellis.operators.distinct import once
from trellis.storage import written
from trellis.plans.compile import Compiler
from trellis.plans.sparql import Query, Update, Var, parse
from trellis.sources import bulk, turtle

SCHEMA = bulk.QUADS
#: An update of at most so many quads goes through the driver; beyond, through a plan.
FEW = 1_000
#: A graph of at most so many triples is kept on the driver once it was read.
CACHED = 20_000
Triple = tuple[str, str, str]


class Graph(frozenset):
    """An immutable set of triples (s, p, o) of tokens."""

    def serialize(self, format: str = "turtle") -> str:
        return turtle.write_ntriples(self) if format in ("nt", "ntriples") else turtle.write_turtle(self)

    @classmethod
    def parse(cls, text: str, format: str = "turtle") -> Graph:
        return cls((s, p, o) for _, s, p, o in turtle.READERS[format](text))

    def objects(self, s: str, p: str) -> list[str]:
        return sorted(o for a, b, o in self if a == s and b == p)

    def subjects(self, p: str, o: str) -> list[str]:
        return sorted(s for s, b, c in self if b == p and c == o)


@runtime_checkable
class GraphStore(Protocol):
    """What a store must offer; any object with these methods will do."""

    def graph_exists(self, graph: str) -> bool: ...
    def get_graph(self, graph: str) -> Graph: ...
    def put_graph(self, graph: str, triples: Iterable[Triple]) -> None: ...
    def post_graph(self, graph: str, triples: Iterable[Triple]) -> None: ...
    def delete_graph(self, graph: str) -> None: ...
    def parse_into(self, graph: str, data: str, format: str = "turtle") -> None: ...
    def list_named_graphs(self) -> list[str]: ...
    def query(self, sparql: str, **bindings: Any) -> list[dict[str, Any]]: ...
    def construct(self, sparql: str, **bindings: Any) -> Graph: ...
    def ask(self, sparql: str, **bindings: Any) -> bool: ...
    def update(self, sparql: str) -> None: ...


class AbstractGraphStore(ABC):
    """A base class for stores. A store may also have refresh_graph_metadata(graph, registry); it is then used."""

    @abstractmethod
    def graph_exists(self, graph: str) -> bool: ...
    @abstractmethod
    def get_graph(self, graph: str) -> Graph: ...
    @abstractmethod
    def put_graph(self, graph: str, triples: Iterable[Triple]) -> None: ...
    @abstractmethod
    def post_graph(self, graph: str, triples: Iterable[Triple]) -> None: ...
    @abstractmethod
    def delete_graph(self, graph: str) -> None: ...
    @abstractmethod
    def parse_into(self, graph: str, data: str, format: str = "turtle") -> None: ...
    @abstractmethod
    def list_named_graphs(self) -> list[str]: ...
    @abstractmethod
    def query(self, sparql: str, **bindings: Any) -> list[dict[str, Any]]: ...
    @abstractmethod
    def construct(self, sparql: str, **bindings: Any) -> Graph: ...
    @abstractmethod
    def ask(self, sparql: str, **bindings: Any) -> bool: ...
    @abstractmethod
    def update(self, sparql: str) -> None: ...


def _named(template: tuple) -> Column:
    """Whether a quad can come from a template: equal where the template has a constant (blank nodes are variables)."""
    fixed = [F.col(c) == t for c, t in zip("gspo", template) if t is not None and not isinstance(t, Var)]
    return functools.reduce(Column.__and__, fixed, F.lit(True))


class SparkStore(AbstractGraphStore):
    """Quads in two layers: `base`, a DataFrame of any size that writes replace by a new plan, and `local`, graphs of small writes
    on the driver. A snapshot is a reference to both, so taking one and going back are free."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None):
        self.spark, self.base, self.local = spark, quads, {}
        self._frame: DataFrame | None = None
        #: The base's graph names, read once a snapshot.
        self._names: set | None = None
        self._read: dict[str, list | None] = {}

    # snapshots
    def snapshot(self):
        return self.base, dict(self.local), self._names

    def restore(self, snapshot) -> None:
        self.base, self.local, self._names = snapshot[0], dict(snapshot[1]), snapshot[2]
        self._frame, self._read = None, {}

    def _changed(self, base: bool = False) -> None:
        self._frame = None
        if base:
            self._names, self._read = None, {}

    @property
    def quads(self) -> DataFrame:
        if self._frame is None:
            bag = self._bag()
            self._frame = bag if self.base is None else once(bag)
        return self._frame

    def _bag(self) -> DataFrame:
        """All quads, some of them perhaps repeated."""
        small = self.spark.createDataFrame([(iri(g), *t) for g, ts in self.local.items() for t in ts], SCHEMA)
        return small if self.base is None else self.base.select("g", "s", "p", "o").unionByName(small)

    def base_names(self) -> set[str]:
        if self._names is None:
            self._names = set() if self.base is None else {r[0][1:-1] for r in self.base.select("g").distinct().collect()}
        return self._names

    def _small(self, graph: str) -> list | None:
        """The triples of a graph of the base with at most CACHED of them, read once a snapshot: the catalog's graphs are asked often."""
        if graph not in self._read:
            found = self.base.where(F.col("g") == iri(graph)).select("s", "p", "o").distinct().limit(CACHED + 1).collect()
            self._read[graph] = [tuple(r) for r in found] if len(found) <= CACHED else None
        return self._read[graph]

    def rows(self, graph: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None) -> list[tuple]:
        """Quads that match a pattern (graph without brackets, terms as tokens); for the catalog's small graphs."""
        names = [graph] if graph is not None else list(self.local)
        out = [(g, *t) for g in names for t in self.local.get(g, ()) if (s is None or t[0] == s) and (p is None or t[1] == p) and (o is None or t[2] == o)]
        small = self._small(graph) if graph is not None and self.base is not None and graph in self.base_names() else None
        if small is not None:
            out = list({*out, *((graph, *t) for t in small if (s is None or t[0] == s) and (p is None or t[1] == p) and (o is None or t[2] == o))})
        elif self.base is not None and (graph is None or graph in self.base_names()):
            df = self.base
            for column, term in (("g", iri(graph) if graph is not None else None), ("s", s), ("p", p), ("o", o)):
                df = df if term is None else df.where(F.col(column) == term)
            out = list({*out, *((r[0][1:-1], r[1], r[2], r[3]) for r in df.select("g", "s", "p", "o").distinct().collect())})
        return sorted(out)

    def graphs_with(self, p: str, o: str) -> set[str]:
        """The graphs that have a triple with this predicate and object: one plan, of which names alone come back."""
        found = {g for g, ts in self.local.items() if any(t[1] == p and t[2] == o for t in ts)}
        if self.base is not None:
            found |= {r[0][1:-1] for r in self.base.where((F.col("p") == p) & (F.col("o") == o)).select("g").distinct().collect()}
        return found

    # graphs
    def graph_exists(self, graph: str) -> bool:
        return bool(self.local.get(graph)) or graph in self.base_names()

    def get_graph(self, graph: str) -> Graph:
        return Graph(t[1:] for t in self.rows(graph))

    def put_graph(self, graph: str, triples: Iterable[Triple]) -> None:
        self.delete_graph(graph)
        self.post_graph(graph, triples)

    def replace_graph_atomically(self, graph: str, triples: Iterable[Triple]) -> None:
        self.put_graph(graph, list(triples))

    def post_graph(self, graph: str, triples: Iterable[Triple]) -> None:
        grown = frozenset(self.local.get(graph, frozenset())) | frozenset(tuple(t) for t in triples)
        if grown:
            self.local = {**self.local, graph: grown}
            self._changed()

    def delete_graph(self, graph: str) -> None:
        if graph in self.base_names():
            self.base = self.base.where(F.col("g") != iri(graph))
            self._changed(True)
        if graph in self.local:
            self.local = {g: ts for g, ts in self.local.items() if g != graph}
            self._changed()

    def remove(self, quads: Iterable[tuple]) -> int:
        """Removes quads (graph without brackets, terms as tokens); how many were there."""
        gone, n = set(quads), 0
        for g in {q[0] for q in gone}:
            have = self.local.get(g, frozenset())
            left = have - {q[1:] for q in gone if q[0] == g}
            n += len(have) - len(left)
            self.local = {**{k: v for k, v in self.local.items() if k != g}, **({g: left} if left else {})}
        if self.base is not None and gone and {q[0] for q in gone} & self.base_names():
            away = self.spark.createDataFrame([(iri(q[0]), *q[1:]) for q in gone], SCHEMA)
            before = self.base
            self.base = written(before.join(away, ["g", "s", "p", "o"], "left_anti"), "quads")
            self._changed(True)
        self._changed()
        return n

    def load(self, quads: DataFrame) -> None:
        """Adds quads of any size."""
        quads = quads.select("g", "s", "p", "o")
        self.base = quads if self.base is None else self.base.unionByName(quads)
        self._changed(True)

    def parse_into(self, graph: str, data: str, format: str = "turtle") -> None:
        quads = turtle.READERS[format](data, iri(graph))
        for g in {q[0] for q in quads}:
            self.post_graph(g[1:-1] if g else graph, [q[1:] for q in quads if q[0] == g])

    def list_named_graphs(self) -> list[str]:
        return sorted({g for g, ts in self.local.items() if ts} | self.base_names())

    # SPARQL
    def _bound(self, bindings: dict) -> dict:
        return {k: v if isinstance(v, str) and v.startswith(("<", "_:", '"')) else iri(v) if isinstance(v, str) and v.startswith("urn:") else literal(v) for k, v in bindings.items()}

    def frame(self, sparql: str, quads: DataFrame | None = None, **bindings) -> DataFrame:
        """The plan of a query: columns of tokens."""
        tree = parse(sparql)
        if not isinstance(tree, Query):
            raise ValueError("this is an update")
        return Compiler(self.spark, self.quads if quads is None else quads, self._bound(bindings)).run(tree)

    def query(self, sparql: str, **bindings) -> list[dict]:
        return [{k: decode(v) for k, v in r.asDict().items() if v is not None} for r in self.frame(sparql, **bindings).collect()]

    def construct(self, sparql: str, quads: DataFrame | None = None, **bindings) -> Graph:
        return Graph(tuple(r) for r in self.frame(sparql, quads, **bindings).collect())

    def ask(self, sparql: str, **bindings) -> bool:
        return bool(self.frame(sparql, **bindings).first()[0])

    def update(self, sparql: str) -> None:
        for u in parse(sparql):
            self._update(u)

    def _update(self, u: Update) -> None:
        plain = lambda quads: [(g[1:-1], s, p, o) for g, s, p, o in quads]
        if u.kind in ("insert data", "delete data"):
            quads = u.insert or u.delete
            if any(q[0] is None for q in quads):
                raise ValueError("every triple lives in a named graph: use GRAPH")
            if u.kind == "delete data":
                self.remove(plain(quads))
            else:
                self._insert(plain((g, *("_:" + t[2:] if t.startswith("_:") else t for t in r)) for g, *r in quads))
        elif u.kind == "modify":
            compiler = Compiler(self.spark, self.quads)
            solution = compiler.group(u.where)
            solution.df = written(solution.df, "match") if solution.names else solution.df
            away, new = (compiler.construct(t, solution) for t in (u.delete, u.insert))
            if any(t[0] is None for t in u.insert):
                raise ValueError("every triple lives in a named graph: use GRAPH")
            few = [df.limit(FEW + 1).collect() for df in (away, new)]
            if max(map(len, few)) <= FEW and not any(t[0] is None for t in u.delete):
                if few[0]:
                    self.remove(set(plain(few[0])))
                self._insert(plain(few[1]))
            else:  # any number of quads: one plan, written; quads that no template can name pass as they are
                named = functools.reduce(Column.__or__, [_named(t) for t in [*u.delete, *u.insert]])
                named = F.coalesce(named, F.lit(False))
                bag = self._bag()
                left = bag.where(named).join(away.where("g is not null"), ["g", "s", "p", "o"], "left_anti")
                if any(t[0] is None for t in u.delete):
                    left = left.join(away.where("g is null").select("s", "p", "o"), ["s", "p", "o"], "left_anti")
                self.base, self.local = written(bag.where(~named).unionByName(once(left.select("g", "s", "p", "o").unionByName(new))), "quads"), {}
                self._changed(True)
        elif u.kind == "drop":
            for g in self.list_named_graphs() if u.target in ("all", "named") else [] if u.target == "default" else [u.target[1:-1]]:
                self.delete_graph(g)
        elif u.kind in ("copy", "move", "add"):
            source, target = u.source[1:-1], u.target[1:-1]
            if source != target:
                if u.kind != "add":
                    self.delete_graph(target)
                if source in self.base_names():
                    self.load(self._bag().where(F.col("g") == u.source).withColumn("g", F.lit(u.target)))
                else:
                    self.post_graph(target, self.local.get(source, ()))
                if u.kind == "move":
                    self.delete_graph(source)
        elif u.kind == "load":
            self.load(bulk.read_lines(self.spark, u.source[1:-1], u.target[1:-1] if u.target else u.source[1:-1]))

    def _insert(self, quads: list) -> None:
        for g in {q[0] for q in quads}:
            self.post_graph(g, [q[1:] for q in quads if q[0] == g])

    # files
    def export_graph(self, graph: str, format: str = "turtle") -> str:
        if not self.graph_exists(graph):
            raise ValueError(f"no graph {graph}")
        return self.get_graph(graph).serialize(format)

    def export(self, format: str = "trig") -> str:
        quads = [(iri(g), *t) for g, *t in self.rows()]
        return turtle.write_nquads(quads) if format in ("nquads", "nq") else turtle.write_trig(quads)

    def save(self, path: str) -> None:
        """All quads as Parquet, clustered by predicate and graph so that patterns prune."""
        self.quads.repartitionByRange("p", "g").sortWithinPartitions("p", "g", "s").write.mode("overwrite").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SparkStore:
        return cls(spark, spark.read.parquet(path))
