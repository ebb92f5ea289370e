"""Triples to triples (DataFrame transforms), and triples to property graphs: as DataFrames, and as one small graph on the driver."""

from __future__ import annotations

import platform
import socket
from collections.abc import Callable
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import RDF, RDFS, SKOS, TYPE, decode
from trellis.model import ProjectedEdge, ProjectedGraph, ProjectedNode, TransformNotFoundError, local_name
from trellis.operators.distinct import once

LABELS = (f"<{RDFS}label>", f"<{SKOS}prefLabel>", f"<{SKOS}altLabel>")
_FIRST, _REST, _NIL, _STATEMENT = f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>", f"<{RDF}Statement>"

# CONSTRUCT texts; {graph} becomes the graph's IRI.
CONSTRUCTS = {
    "strip_types": f"CONSTRUCT {{ ?s ?p ?o }} WHERE {{ GRAPH <{{graph}}> {{ ?s ?p ?o FILTER(?p != {TYPE}) }} }}",
    "object_properties_only": "CONSTRUCT { ?s ?p ?o } WHERE { GRAPH <{graph}> { ?s ?p ?o FILTER(isIRI(?o)) } }",
    "data_properties_only": "CONSTRUCT { ?s ?p ?o } WHERE { GRAPH <{graph}> { ?s ?p ?o FILTER(isLiteral(?o)) } }",
    "collapse_reification": f"CONSTRUCT {{ ?s ?p ?o }} WHERE {{ GRAPH <{{graph}}> {{ ?x a {_STATEMENT} ; <{RDF}subject> ?s ; <{RDF}predicate> ?p ; <{RDF}object> ?o }} }}",
    "labels_only": f"CONSTRUCT {{ ?s <{RDFS}label> ?l }} WHERE {{ GRAPH <{{graph}}> {{ {{ ?s {LABELS[0]} ?l }} UNION {{ ?s {LABELS[1]} ?l }} UNION {{ ?s {LABELS[2]} ?l }} }} }}",
    "subclass_tree": f"CONSTRUCT {{ ?a <{RDFS}subClassOf> ?b . ?a <{RDFS}label> ?x . ?b <{RDFS}label> ?y }} WHERE {{ GRAPH <{{graph}}> {{ ?a <{RDFS}subClassOf> ?b OPTIONAL {{ ?a <{RDFS}label> ?x }} OPTIONAL {{ ?b <{RDFS}label> ?y }} }} }}",
}


def build_construct(template: str, graph_iri: str) -> str:
    return template.replace("{graph}", graph_iri)


# DataFrame transforms of (s, p, o)


def strip_types(df: DataFrame) -> DataFrame:
    return df.where(F.col("p") != TYPE)


def object_properties_only(df: DataFrame) -> DataFrame:
    return df.where(T.is_iri(F.col("o")))


def data_properties_only(df: DataFrame) -> DataFrame:
    return df.where(T.is_literal(F.col("o")))


def labels_only(df: DataFrame) -> DataFrame:
    return once(df.where(F.col("p").isin(*LABELS)).withColumn("p", F.lit(LABELS[0])))


def subclass_tree(df: DataFrame) -> DataFrame:
    pairs = df.where(F.col("p") == f"<{RDFS}subClassOf>")
    ends = pairs.select("s").unionByName(pairs.select(F.col("o").alias("s"))).distinct()
    return once(pairs.unionByName(df.where(F.col("p") == LABELS[0]).join(ends, "s", "left_semi")))


def strip_blank_nodes(df: DataFrame) -> DataFrame:
    return df.where(~T.is_blank(F.col("s")) & ~T.is_blank(F.col("o")))


def collapse_reification(df: DataFrame) -> DataFrame:
    """Statements become triples; one pass over their parts. A statement needs all three parts."""
    parts = [f"<{RDF}{x}>" for x in ("subject", "predicate", "object")]
    x = df.where(F.col("p").isin(TYPE, *parts)).groupBy("s").agg(F.max(F.col("o") == _STATEMENT).alias("st"), *[F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in zip(parts, ("a", "b", "c"))])
    x = x.where("st").select(F.explode("a").alias("s"), "b", "c").select("s", F.explode("b").alias("p"), "c")
    return x.select("s", "p", F.explode("c").alias("o")).distinct()


def extract_types(df: DataFrame) -> DataFrame:
    """(s, types) of IRI subjects."""
    return df.where((F.col("p") == TYPE) & T.is_iri(F.col("s"))).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("types"))


def filter_by_class(df: DataFrame, cls: str) -> DataFrame:
    """All triples of direct instances."""
    return df.join(df.where((F.col("p") == TYPE) & (F.col("o") == T.iri(cls))).select("s").distinct(), "s", "left_semi").select("s", "p", "o")


def localize_predicates(df: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace(T.lexical(F.col("p")), "(?s)^.*/", ""), "(?s)^.*#", "")
    return once(df.withColumn("p", T.encode_iri(F.concat(F.lit("urn:local:"), name))))


def lpg_nodes(df: DataFrame) -> DataFrame:
    """(iri, types, label, attributes): IRI subjects and targets; attributes is JSON, scalars or arrays of lexical forms."""
    own = df.where(T.is_iri(F.col("s")))
    label = F.col("p").isin(*LABELS[:2])
    literal = T.is_literal(F.col("o"))
    attributes = own.where(literal).groupBy("s", "p").agg(F.array_sort(F.collect_set(T.lexical(F.col("o")))).alias("v"))
    attributes = attributes.select("s", F.regexp_replace(T.lexical(F.col("p")), "(?s)^.*[/#:]", "").alias("k"), F.when(F.size("v") == 1, F.to_json(F.struct(F.get("v", F.lit(0)).alias("v")))).otherwise(F.to_json(F.struct("v"))).alias("v"))
    attributes = attributes.groupBy("s").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("k"), F.lit('":'), F.regexp_replace("v", r'(?s)^\{"v":(.*)\}$', "$1")))), ","), F.lit("}")).alias("attributes"))
    nodes = own.groupBy("s").agg(F.array_sort(F.collect_set(F.when(F.col("p") == TYPE, F.col("o")))).alias("types"), F.max(F.when(label & literal, T.lexical(F.col("o")))).alias("label"))
    targets = own.where(T.is_iri(F.col("o")) & (F.col("p") != TYPE) & ~label).select(F.col("o").alias("s")).distinct().join(nodes.select("s"), "s", "left_anti")
    every = nodes.join(attributes, "s", "left").unionByName(targets, allowMissingColumns=True)
    return every.select(T.lexical(F.col("s")).alias("iri"), F.coalesce(F.transform("types", lambda t: T.lexical(t)), F.array().cast("array<string>")).alias("types"), "label", F.coalesce("attributes", F.lit("{}")).alias("attributes"))


def lpg_edges(df: DataFrame) -> DataFrame:
    """(source, predicate, target) between IRIs, without types and labels."""
    out = df.where(T.is_iri(F.col("s")) & T.is_iri(F.col("o")) & (F.col("p") != TYPE) & ~F.col("p").isin(*LABELS[:2]))
    return once(out.select(T.lexical(F.col("s")).alias("source"), T.lexical(F.col("p")).alias("predicate"), T.lexical(F.col("o")).alias("target")))


# One small graph on the driver


def project_to_lpg(triples, collapse_types=True, resolve_blanks=True, resolve_lists=True, collapse_labels=True, include=None, exclude=None) -> ProjectedGraph:
    """Triples of tokens -> property graph. include and exclude: predicate IRIs, for literals, labels and edges."""
    triples = sorted(triples)
    by: dict = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
    is_cell = {s for s, ps in by.items() if s.startswith("_:") and any(p in (_FIRST, _REST) for p, _ in ps)}
    objects = {o for _, _, o in triples if o.startswith("_:")}
    graph = ProjectedGraph()

    def node(s: str) -> ProjectedNode:
        return graph.nodes.setdefault(s if s.startswith("_:") else s[1:-1], ProjectedNode(s if s.startswith("_:") else s[1:-1]))

    def nested(o: str, seen: frozenset):
        if not o.startswith("_:"):
            return decode(o)
        if o in seen:
            return o
        if o in is_cell:
            items, walked = [], set()
            while o != _NIL and o in by and o not in walked:
                walked.add(o)
                parts = dict(by[o])
                if _FIRST in parts:
                    items.append(nested(parts[_FIRST], seen | {o}))
                o = parts.get(_REST, _NIL)
            return items
        return {local_name(p[1:-1]): nested(x, seen | {o}) for p, x in by.get(o, [])}

    def put(n: ProjectedNode, p: str, value):
        key = p[1:-1]
        if key in n.attributes:
            old = n.attributes[key]
            n.attributes[key] = [*old, value] if isinstance(old, list) else [old, value]
        else:
            n.attributes[key] = value

    for s, p, o in triples:
        blank = s.startswith("_:")
        if blank and (s in is_cell and resolve_lists or s in objects and resolve_blanks):
            continue
        if not blank:
            node(s).attributes["iri"] = s[1:-1]
        if p == TYPE and collapse_types and not blank:
            node(s).types.append(decode(o))
            continue
        if include is not None and p[1:-1] not in include or exclude is not None and p[1:-1] in exclude:
            continue
        if p in LABELS[:2] and collapse_labels:
            if not blank:
                node(s).label = str(decode(o))
                node(s).attributes[p[1:-1]] = decode(o)
        elif o.startswith('"'):
            if not blank:
                put(node(s), p, decode(o))
        elif o.startswith("_:"):
            if not blank and (o in is_cell and resolve_lists or o not in is_cell and resolve_blanks):
                put(node(s), p, nested(o, frozenset()))
        else:
            if o == _NIL and resolve_lists and not blank:
                put(node(s), p, [])
                continue
            node(o)
            graph.edges.append(ProjectedEdge(s if blank else s[1:-1], p[1:-1], o[1:-1]))
    return graph


def collapse_reification_lpg(triples, preserve_metadata: bool = True) -> ProjectedGraph:
    by: dict = {}
    for s, p, o in sorted(triples):
        by.setdefault(s, []).append((p, o))
    graph = ProjectedGraph()
    for ps in by.values():
        parts = dict(ps)
        if (TYPE, _STATEMENT) in ps and all(f"<{RDF}{x}>" in parts for x in ("subject", "predicate", "object")):
            a, p, b = (decode(parts[f"<{RDF}{x}>"]) for x in ("subject", "predicate", "object"))
            more = {q[1:-1]: decode(o) for q, o in ps if q != TYPE and not q.startswith(f"<{RDF}")} if preserve_metadata else {}
            graph.edges.append(ProjectedEdge(str(a), str(p), str(b), more))
            for x in (a, b):
                graph.nodes.setdefault(str(x), ProjectedNode(str(x)))
    return graph


# The registry of named transforms: DataFrame -> DataFrame over (s, p, o)
ENTRY_POINTS = "trellis.projections"
_OWN: dict[str, Callable[[DataFrame], DataFrame]] = {}


def transform(name: str):
    """Registers a DataFrame -> DataFrame function under a name."""

    def register(f):
        _OWN[name] = f
        return f

    return register


for _name, _f in (("strip_types", strip_types), ("strip_blank_nodes", strip_blank_nodes), ("object_properties_only", object_properties_only), ("data_properties_only", data_properties_only), ("labels_only", labels_only), ("subclass_tree", subclass_tree), ("localize_predicates", localize_predicates), ("collapse_reification", collapse_reification)):
    transform(_name)(_f)


def transforms() -> dict[str, Callable]:
    """All named transforms; ours win over plugins of the same name, broken plugins are left out."""
    found = {}
    for e in metadata.entry_points(group=ENTRY_POINTS):
        try:
            found[e.name] = e.load()
        except Exception:  # a broken plugin must not stop the others
            continue
    return found | _OWN


def resolve_transform(name: str) -> Callable:
    found = transforms()
    if name not in found:
        raise TransformNotFoundError(name)
    return found[name]


def transform_version(name: str) -> str:
    f = resolve_transform(name)
    try:
        return metadata.version(f.__module__.split(".")[0])
    except metadata.PackageNotFoundError:
        return getattr(f, "__version__", "unknown")


def host_metadata() -> dict[str, str]:
    return {"host": socket.gethostname(), "platform": platform.platform(), "python": platform.python_version()}


class Pipeline:
    """Named steps over (s, p, o): transforms and CONSTRUCTs, each on what the step before gives."""

    def __init__(self, name: str = ""):
        self.name, self.steps = name, []

    def add(self, name: str, step: str | Callable) -> Pipeline:
        """step: a registered transform's name, a function, or the text of a CONSTRUCT."""
        if isinstance(step, str) and "CONSTRUCT" not in step.upper():
            step = resolve_transform(step)
        self.steps.append((name, step))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = construct(df, step) if isinstance(step, str) else df.transform(step)
        return df

    def apply_to_lpg(self, df: DataFrame, **options) -> ProjectedGraph:
        return project_to_lpg([tuple(r) for r in self.apply(df).select("s", "p", "o").collect()], **options)


def construct(df: DataFrame, text: str) -> DataFrame:
    """A CONSTRUCT over triples (s, p, o) alone."""
    from trellis.plans.compile import Compiler
    from trellis.plans.sparql import parse

    return Compiler(df.sparkSession, df.select(F.lit("<urn:step>").alias("g"), "s", "p", "o")).run(parse(text))
