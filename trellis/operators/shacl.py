"""SHACL core and SPARQL constraints: shapes are read on the driver, each constraint becomes a DataFrame plan of violations."""

from __future__ import annotations

import dataclasses
import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import RDF, RDFS, SH, TYPE, XSD, decode
from trellis.operators.distinct import once
from trellis.operators.fixpoint import closure

REPORT = "shape string, focus string, path string, value string, message string, severity string, component string"
_NIL = f"<{RDF}nil>"


class Shapes:
    """The triples of a shapes graph, indexed."""

    def __init__(self, triples):
        self.by: dict = {}
        for s, p, o in sorted(triples):
            self.by.setdefault(s, {}).setdefault(p, []).append(o)

    def all(self, s: str, name: str) -> list[str]:
        return self.by.get(s, {}).get(f"<{SH}{name}>", [])

    def one(self, s: str, name: str) -> str | None:
        return next(iter(self.all(s, name)), None)

    def list(self, head: str) -> list[str]:
        out = []
        while head and head != _NIL:
            out += self.by.get(head, {}).get(f"<{RDF}first>", [])
            head = next(iter(self.by.get(head, {}).get(f"<{RDF}rest>", [])), None)
        return out

    def targets(self) -> list[str]:
        typed = [s for s, ps in self.by.items() if f"<{SH}NodeShape>" in ps.get(TYPE, [])]
        return sorted({*typed, *(s for s, ps in self.by.items() if {f"<{SH}{x}>" for x in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "target")} & set(ps))})

    def prefixes(self, s: str) -> dict:
        out = {}
        for holder in self.all(s, "prefixes"):
            for d in self.all(holder, "declare"):
                out[decode(self.one(d, "prefix"))] = decode(self.one(d, "namespace"))
        return out


def validate(data: DataFrame, shapes_triples, quads: DataFrame | None = None) -> DataFrame:
    """data (s, p, o) against shapes -> report rows. data may have a column `unit`: then every unit is validated by
    itself in the same plan, and the report has it too. quads: what SPARQL constraints may see (default: data)."""
    return Validator(data, Shapes(shapes_triples), quads).report()


class Validator:
    def __init__(self, data: DataFrame, shapes: Shapes, quads: DataFrame | None = None):
        self.keys = ["unit"] if "unit" in data.columns else []
        self.data, self.shapes, self.spark, self.fresh = once(data.select(*self.keys, "s", "p", "o")), shapes, data.sparkSession, itertools.count()
        self.quads = quads if quads is not None else data.select(F.lit("<urn:data>").alias("g"), "s", "p", "o")
        self._classes: dict = {}

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], ("unit string, " if self.keys else "") + REPORT)

    def report(self) -> DataFrame:
        parts = []
        for shape in self.shapes.targets():
            if self.shapes.one(shape, "deactivated") == T.literal(True):
                continue
            focus = self.focus(shape)
            if focus is not None:
                parts += self.constraints(shape, focus, shape)
        return functools.reduce(DataFrame.unionByName, parts, self.empty())

    def members(self, cls: str) -> DataFrame:
        """Instances (x) of a class or of its subclasses in the data."""
        if cls not in self._classes:
            up = self.data.where(F.col("p") == f"<{RDFS}subClassOf>").select(*self.keys, F.col("s").alias("a"), F.col("o").alias("b"))
            typed = self.data.where(F.col("p") == TYPE).select(*self.keys, F.col("s").alias("x"), F.col("o").alias("c"))
            direct = typed.where(F.col("c") == cls).select(*self.keys, "x")
            if not up.isEmpty():
                below = closure(up, self.keys).where(F.col("b") == cls).select(*self.keys, F.col("a").alias("c"))
                direct = direct.unionByName(typed.join(below, [*self.keys, "c"], "left_semi").select(*self.keys, "x")).distinct()
            self._classes[cls] = direct.distinct()
        return self._classes[cls]

    def focus(self, shape: str) -> DataFrame | None:
        parts = []
        sh, keys = self.shapes, self.keys
        classes = sh.all(shape, "targetClass")
        if f"<{RDFS}Class>" in sh.by.get(shape, {}).get(TYPE, []):
            classes = [*classes, shape]
        parts += [self.members(c).select(*keys, F.col("x").alias("focus")) for c in classes]
        for node in sh.all(shape, "targetNode"):
            base = self.data.select(*keys).distinct() if keys else self.spark.range(1).select()
            parts.append(base.withColumn("focus", F.lit(node)))
        for name, column in (("targetSubjectsOf", "s"), ("targetObjectsOf", "o")):
            parts += [self.data.where(F.col("p") == p).select(*keys, F.col(column).alias("focus")) for p in sh.all(shape, name)]
        for target in sh.all(shape, "target"):
            select = sh.one(target, "select")
            if select:
                found = self.sparql(decode(select), sh.prefixes(target))
                found = found if not keys or "unit" in found.columns else found.join(self.data.select("unit", F.col("s").alias("this")).distinct(), "this")
                parts.append(found.select(*keys, F.col("this").alias("focus")))
        return functools.reduce(DataFrame.unionByName, parts).distinct() if parts else None

    def sparql(self, text: str, prefixes: dict) -> DataFrame:
        from trellis.plans.compile import Compiler
        from trellis.plans.sparql import Parser, Var

        q = Parser(text, prefixes).parse()
        if self.keys and not _names_graphs(q.where):  # every unit's data by itself: the unit is the graph
            unit = Var("unit")
            q = dataclasses.replace(q, where=[("graph", unit, q.where)], project=[*q.project, (("var", unit), unit)] if q.project is not None else None, group=[*q.group, (("var", unit), unit)] if q.group else q.group)
            return Compiler(self.spark, self.data.select(F.col("unit").alias("g"), "s", "p", "o")).run(q)
        return Compiler(self.spark, self.quads).run(q)

    # paths
    def path(self, p: str):
        """A path of the shapes graph as the compiler's path."""
        sh = self.shapes
        if p.startswith("<") and p != _NIL:
            return p
        for name, kind in (("inversePath", "inv"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if inner := sh.one(p, name):
                return (kind, self.path(inner))
        if head := sh.one(p, "alternativePath"):
            return ("alt", *map(self.path, sh.list(head)))
        return ("seq", *map(self.path, sh.list(p)))

    def values(self, focus: DataFrame, path) -> DataFrame:
        """(focus, value) of the focus nodes that have the path."""
        if isinstance(path, str):
            edges = self.data.where(F.col("p") == path).select(*self.keys, F.col("s").alias("focus"), F.col("o").alias("value"))
        else:
            from trellis.plans.compile import Compiler
            from trellis.plans.sparql import Var

            graphs = self.data.select((F.col("unit") if self.keys else F.lit("<urn:data>")).alias("g"), "s", "p", "o")
            pairs = Compiler(self.spark, graphs).pairs(path, Var("g"))
            edges = pairs.select(*([F.col("g").alias("unit")] if self.keys else []), F.col("a").alias("focus"), F.col("b").alias("value")).distinct()
        return edges.join(focus, [*self.keys, "focus"], "left_semi")

    # constraints
    def constraints(self, shape: str, focus: DataFrame, name: str, path=None, label: str | None = None) -> list[DataFrame]:
        sh, keys = self.shapes, self.keys
        if sh.one(shape, "deactivated") == T.literal(True):
            return []
        messages = [decode(m) for m in sh.all(shape, "message")]
        severity = (sh.one(shape, "severity") or f"<{SH}Violation>")[1:-1]
        values = focus.withColumn("value", F.col("focus")) if path is None else self.values(focus, path)
        out = []

        def bad(df: DataFrame, component: str, value: Column | None, message: Column | str | None = None):
            text = F.lit(messages[0] if messages else message) if not isinstance(message, Column) or messages else message
            out.append(df.select(*keys, F.lit(name).alias("shape"), "focus", F.lit(label).cast("string").alias("path"), (F.lit(None) if value is None else value).cast("string").alias("value"), text.cast("string").alias("message"), F.lit(severity).alias("severity"), F.lit(component).alias("component")))

        def wrong(condition: Column, component: str, message: str):
            bad(values.where(~F.coalesce(condition, F.lit(False))), component, F.col("value"), message)

        value = F.col("value")
        if path is not None:
            least, most = (sh.one(shape, x) for x in ("minCount", "maxCount"))
            if least or most:
                counts = focus.join(values.groupBy(*keys, "focus").agg(F.count("*").alias("n")), [*keys, "focus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                if least and int(decode(least)) > 0:
                    bad(counts.where(F.col("n") < int(decode(least))), "MinCount", None, f"fewer than {decode(least)} values")
                if most:
                    bad(counts.where(F.col("n") > int(decode(most))), "MaxCount", None, f"more than {decode(most)} values")
        for kind in sh.all(shape, "datatype"):
            text, plain = T.lexical(value), kind[1:-1]
            fits = T.datatype(value) == plain
            if plain.removeprefix(XSD) in T.NUMERIC:
                fits &= T.number(value).isNotNull()
            elif plain == XSD + "boolean":
                fits &= text.isin("true", "false", "0", "1")
            elif plain in (XSD + "dateTime", XSD + "date"):
                fits &= text.try_cast("timestamp").isNotNull()
            wrong(fits, "Datatype", f"value is not of datatype {plain}")
        for kind in sh.all(shape, "nodeKind"):
            name_ = kind[1:-1].removeprefix(SH)
            fits = F.lit(False)
            for part, test in (("IRI", T.is_iri), ("BlankNode", T.is_blank), ("Literal", T.is_literal)):
                if part in name_:
                    fits = fits | test(value)
            wrong(fits, "NodeKind", f"value is not of kind {name_}")
        for cls in sh.all(shape, "class"):
            bad(values.join(self.members(cls).withColumnRenamed("x", "value"), [*keys, "value"], "left_anti"), "Class", value, f"value is no instance of {cls[1:-1]}")
        for head in sh.all(shape, "in"):
            wrong(value.isin(sh.list(head)), "In", "value is not in the list")
        for wanted in sh.all(shape, "hasValue"):
            bad(focus.join(values.where(value == wanted), [*keys, "focus"], "left_anti"), "HasValue", None, f"value {wanted} is missing")
        for which, test in (("minInclusive", lambda x, y: x >= y), ("minExclusive", lambda x, y: x > y), ("maxInclusive", lambda x, y: x <= y), ("maxExclusive", lambda x, y: x < y)):
            for limit in sh.all(shape, which):
                wrong(F.coalesce(test(T.number(value), T.number(F.lit(limit))), test(T.timestamp(value), T.timestamp(F.lit(limit)))), which[0].upper() + which[1:], f"value is against {which} {decode(limit)}")
        for which, test in (("minLength", lambda n, k: n >= k), ("maxLength", lambda n, k: n <= k)):
            for limit in sh.all(shape, which):
                wrong(~T.is_blank(value) & test(F.length(T.lexical(value)), int(decode(limit))), which[0].upper() + which[1:], f"length is against {which} {decode(limit)}")
        for pattern in sh.all(shape, "pattern"):
            flags = decode(sh.one(shape, "flags") or '""')
            wrong(~T.is_blank(value) & T.lexical(value).rlike((f"(?{flags})" if flags else "") + decode(pattern)), "Pattern", f"value does not match {decode(pattern)}")
        for head in sh.all(shape, "languageIn"):
            wrong(F.lower(T.lang(value)).isin([decode(x).lower() for x in sh.list(head)]), "LanguageIn", "language is not in the list")
        if sh.one(shape, "uniqueLang") == T.literal(True):
            tags = values.withColumn("tag", F.lower(T.lang(value))).where("tag <> ''").groupBy(*keys, "focus", "tag").count().where("count > 1")
            bad(tags, "UniqueLang", None, "a language has several values")
        for which, op in (("equals", None), ("disjoint", None), ("lessThan", False), ("lessThanOrEquals", True)):
            for other in sh.all(shape, which):
                theirs = self.values(focus, other)
                if which == "equals":
                    bad(values.join(theirs, [*keys, "focus", "value"], "left_anti"), "Equals", value, f"values differ from {other[1:-1]}")
                    bad(theirs.join(values, [*keys, "focus", "value"], "left_anti"), "Equals", value, f"values differ from {other[1:-1]}")
                elif which == "disjoint":
                    bad(values.join(theirs, [*keys, "focus", "value"], "left_semi"), "Disjoint", value, f"value is also in {other[1:-1]}")
                else:
                    pairs = values.join(theirs.withColumnRenamed("value", "other"), [*keys, "focus"])
                    x, y = (F.coalesce(T.number(c), T.timestamp(c).cast("double")) for c in (value, F.col("other")))
                    bad(pairs.where(~F.coalesce(x <= y if op else x < y, F.lit(False))), which[0].upper() + which[1:], value, f"value is not below {other[1:-1]}")
        if sh.one(shape, "closed") == T.literal(True):
            allowed = {*sh.list(sh.one(shape, "ignoredProperties")), *(sh.one(x, "path") for x in sh.all(shape, "property"))}
            others = self.data.where(~F.col("p").isin([a for a in allowed if a])).select(*keys, F.col("s").alias("focus"), F.col("o").alias("value"))
            bad(others.join(focus, [*keys, "focus"], "left_semi"), "Closed", value, "property is not allowed")
        # shapes within shapes: a node conforms if no report row has it as focus
        for which in ("node", "not", "and", "or", "xone"):
            for inner in sh.all(shape, which):
                many = [inner] if which in ("node", "not") else sh.list(inner)
                nodes = values.select(*keys, F.col("value").alias("focus")).distinct()
                failed = [self.failing(x, nodes) for x in many]
                if which == "and":
                    for f in failed:
                        bad(values.join(f, [*keys, "value"], "left_semi"), "And", value, "value does not conform to all shapes")
                    continue
                counted = functools.reduce(DataFrame.unionByName, failed).groupBy(*keys, "value").agg(F.count("*").alias("n"))
                counted = values.join(counted, [*keys, "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                good = {"node": F.col("n") == 0, "not": F.col("n") > 0, "or": F.col("n") < len(many), "xone": F.col("n") == len(many) - 1}[which]
                bad(counted.where(~good), which.capitalize(), value, f"value does not conform ({which})")
        for inner in sh.all(shape, "qualifiedValueShape"):
            fine = values.join(self.failing(inner, values.select(*keys, F.col("value").alias("focus")).distinct()), [*keys, "value"], "left_anti")
            counts = focus.join(fine.groupBy(*keys, "focus").agg(F.count("*").alias("n")), [*keys, "focus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            for which, worse in (("qualifiedMinCount", lambda n, k: n < k), ("qualifiedMaxCount", lambda n, k: n > k)):
                for limit in sh.all(shape, which):
                    bad(counts.where(worse(F.col("n"), int(decode(limit)))), which[0].upper() + which[1:], None, f"{which} {decode(limit)} is not met")
        for query in sh.all(shape, "sparql"):
            if text := sh.one(query, "select"):
                hits = self.sparql(decode(text), {**sh.prefixes(query), **sh.prefixes(shape)})
                own = [decode(m) for m in sh.all(query, "message")]
                shown = F.col("value") if "value" in hits.columns else F.col("this")
                hits = hits.withColumn("focus", F.col("this")).withColumn("value", shown)
                # A query that names graphs sees them all; its rows then belong to every unit whose focus node it is.
                hits = hits.join(focus, [*keys, "focus"], "left_semi") if not keys or "unit" in hits.columns else hits.join(focus, "focus")
                bad(hits, "SPARQL", F.col("value"), F.lit(own[0] if own else "SPARQL constraint"))
        for inner in sh.all(shape, "property"):
            if p := sh.one(inner, "path"):
                at = values.select(*keys, F.col("value").alias("focus")).distinct() if path is not None else focus
                out += self.constraints(inner, at, name, self.path(p), p[1:-1] if p.startswith("<") else str(self.path(p)))
        return out

    def failing(self, shape: str, nodes: DataFrame) -> DataFrame:
        """The nodes (value) that do not conform to a shape."""
        p = self.shapes.one(shape, "path")
        parts = self.constraints(shape, nodes, shape, self.path(p) if p else None, p[1:-1] if p else None)
        return functools.reduce(DataFrame.unionByName, parts, self.empty()).select(*self.keys, F.col("focus").alias("value")).distinct()


def _names_graphs(e) -> bool:
    """Whether a pattern has GRAPH, or a sub-select, whose variables are its own."""
    return isinstance(e, (tuple, list)) and bool(e) and (e[0] in ("graph", "select") or any(_names_graphs(x) for x in e))


def health(report: DataFrame, units: DataFrame) -> DataFrame:
    """(unit) -> unit, health: compromised with a violation, weakened with a warning, else intact."""
    worst = report.groupBy("unit").agg(F.max(F.col("severity").endswith("Violation")).alias("v"), F.max(F.col("severity").endswith("Warning")).alias("w"))
    return units.join(worst, "unit", "left").select("unit", F.when(F.col("v"), "compromised").when(F.col("w"), "weakened").otherwise("intact").alias("health"))
