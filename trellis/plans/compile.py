"""SPARQL syntax tree -> DataFrame plan over quads (g, s, p, o).

Each variable is a column of tokens. A Solution knows which variables are certainly bound: joins on these are plain equi-joins,
and only a variable that an OPTIONAL or a UNION may leave unbound pays for the condition that unbound is compatible with
anything. Constants become equality filters that reach the scan. Patterns of a group are joined in an order that
keeps them connected and starts with the most constants. Expressions never raise: an error is null."""

from __future__ import annotations

import dataclasses
import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.sparql import Value, call, compare, truth
from trellis.plans.sparql import Query, Var
from trellis.operators.distinct import once
from trellis.operators.fixpoint import closure

#: Up to so many variables that may be unbound, an anti join is split by which of them are bound.
SPLIT = 4


class Solution:
    def __init__(self, df: DataFrame, sure: set[str], maybe: set[str] = frozenset()):
        self.df, self.sure, self.maybe = df, set(sure), set(maybe) - set(sure)

    @property
    def names(self) -> list[str]:
        return sorted(self.sure | self.maybe)


class Compiler:
    def __init__(self, spark: SparkSession, quads: DataFrame, bindings: dict[str, str] | None = None):
        self.spark, self.quads, self.bindings = spark, quads, bindings or {}
        self.default = quads  # what patterns outside GRAPH see
        self.fresh = itertools.count()

    # solutions
    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(), set())

    def scan(self, graph) -> tuple[DataFrame, str | None]:
        """The triples that a graph context sees; for a variable, with its column g."""
        if graph is None:
            return once(self.default.select("s", "p", "o")), None
        if isinstance(graph, Var):
            return self.quads, graph
        return self.quads.where(F.col("g") == graph).select("s", "p", "o"), None

    def triple(self, s, p, o, graph) -> Solution:
        if isinstance(p, tuple):
            return self.path(s, p, o, graph)
        if graph is None:  # filter first, then drop what several graphs repeat
            df, g = self.default, None
        else:
            df, g = self.scan(graph)
        seen: dict[str, str] = {}
        for column, term in (("s", s), ("p", p), ("o", o), ("g", g)):
            if term is None:
                continue
            if not isinstance(term, Var):
                df = df.where(F.col(column) == term)
            elif term in seen:
                df = df.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        if graph is None:
            df = once(df.select("s", "p", "o"))
        return Solution(df.select(*[F.col(c).alias(v) for v, c in seen.items()]), set(seen))

    def path(self, s, p, o, graph) -> Solution:
        pairs = self.pairs(p, graph, s if not isinstance(s, Var) else None, o if not isinstance(o, Var) else None)
        g = graph if isinstance(graph, Var) else None
        seen: dict[str, str] = {}
        for column, term in (("a", s), ("b", o), ("g", g)):
            if term is None:
                continue
            if not isinstance(term, Var):
                pairs = pairs.where(F.col(column) == term)
            elif term in seen:
                pairs = pairs.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        return Solution(pairs.select(*[F.col(c).alias(v) for v, c in seen.items()]), set(seen))

    def pairs(self, p, graph, start=None, stop=None) -> DataFrame:
        """The pairs (a, b) that a path links; for a graph variable, with g."""
        keep = ["g"] if isinstance(graph, Var) else []
        if not isinstance(p, tuple):
            df, _ = self.scan(graph)
            return df.where(F.col("p") == p).select(*keep, F.col("s").alias("a"), F.col("o").alias("b"))
        kind, rest = p[0], p[1:]
        if kind == "inv":
            return self.pairs(rest[0], graph, stop, start).select(*keep, F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            out = self.pairs(rest[0], graph, start)
            for k, part in enumerate(rest[1:]):
                right = self.pairs(part, graph, None, stop if k == len(rest) - 2 else None).select(*keep, F.col("a").alias("m"), F.col("b").alias("c"))
                out = out.withColumnRenamed("b", "m").join(right, [*keep, "m"]).select(*keep, "a", F.col("c").alias("b"))
            return out
        if kind == "alt":
            return functools.reduce(DataFrame.unionByName, [self.pairs(x, graph, start, stop) for x in rest])
        if kind == "not":
            df, _ = self.scan(graph)
            plain = [x for x in rest if not isinstance(x, tuple)]
            back = [x[1] for x in rest if isinstance(x, tuple)]
            out = df.where(~F.col("p").isin(plain)).select(*keep, F.col("s").alias("a"), F.col("o").alias("b")) if plain or not back else None
            if back:
                reverse = df.where(~F.col("p").isin(back)).select(*keep, F.col("o").alias("a"), F.col("s").alias("b"))
                out = reverse if out is None else out.unionByName(reverse)
            return out
        edges = self.pairs(rest[0], graph)
        df, _ = self.scan(graph)
        if kind in ("star", "opt"):
            nodes = df.select(*keep, F.col("s").alias("a")).unionByName(df.select(*keep, F.col("o").alias("a"))).distinct()
            for constant in (start, stop):
                if constant is not None and not keep:
                    nodes = nodes.unionByName(self.spark.createDataFrame([(constant,)], "a string")).distinct()
            same = nodes.select(*keep, "a", F.col("a").alias("b"))
            if kind == "opt":
                return same.unionByName(edges.select(*keep, "a", "b")).distinct()
        if start is None and stop is not None:
            reached = closure(edges.select(*keep, F.col("b").alias("a"), F.col("a").alias("b")), keep, stop).select(*keep, F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            reached = closure(edges, keep, start)
        return reached if kind == "plus" else reached.unionByName(same).distinct()

    def join(self, a: Solution, b: Solution, how: str = "inner", extra: list = (), minus: bool = False) -> Solution:
        """Natural join; extra: filters of an OPTIONAL that belong to the condition; minus: one variable must be bound on both sides."""
        both = [v for v in a.names if v in b.names]
        if not both and not extra and how == "inner":
            return Solution(a.df.crossJoin(b.df), a.sure | b.sure, a.maybe | b.maybe)
        plain = [v for v in both if v in a.sure and v in b.sure]
        if len(plain) == len(both) and not extra and how in ("inner", "left"):
            df = a.df.join(b.df, both, how) if both else a.df.join(b.df, F.lit(True), how)
            sure = a.sure | b.sure if how == "inner" else a.sure
            return Solution(df, sure, a.maybe | b.maybe | (b.sure if how == "left" else set()))
        tag = f"__r{next(self.fresh)}_"
        right = b.df.select(*[F.col(v).alias(tag + v) for v in b.names])
        condition = [F.col(v) == F.col(tag + v) if v in plain else F.col(v).isNull() | F.col(tag + v).isNull() | (F.col(v) == F.col(tag + v)) for v in both]
        if minus and not plain:
            condition.append(functools.reduce(Column.__or__, [F.coalesce(F.col(v) == F.col(tag + v), F.lit(False)) for v in both]))
        if extra:
            columns = {v: F.coalesce(F.col(v), F.col(tag + v)) if v in both else F.col(tag + v) if v in b.names else F.col(v) for v in {*a.names, *b.names}}
            condition += [truth(self.value(e, columns)) for e in extra]
        on = functools.reduce(Column.__and__, condition) if condition else F.lit(True)
        if how == "left_anti" and not plain and 0 < len(both) <= SPLIT:
            return Solution(self.without(a, right, tag, both, condition[len(both) + minus :], minus), a.sure, a.maybe)
        joined = a.df.join(right, on, how)
        if how in ("left_semi", "left_anti"):
            return Solution(joined, a.sure, a.maybe)
        names = [*a.names, *[v for v in b.names if v not in a.names]]
        out = joined.select(*[(F.coalesce(F.col(v), F.col(tag + v)) if v in both else F.col(v) if v in a.names else F.col(tag + v)).alias(v) for v in names])
        sure = a.sure | b.sure if how == "inner" else a.sure
        return Solution(out, sure, set(names) - sure)

    def without(self, a: Solution, right: DataFrame, tag: str, both: list, extra: list, minus: bool) -> DataFrame:
        """An anti join where no shared variable is sure on both sides: one join on equal keys for each set of variables that may be
        bound on both, instead of one that compares all rows. Unbound on the left is a key of its own, so that such rows don't meet in a task."""
        df, own = a.df, F.concat(F.lit("\0"), F.xxhash64(*[F.col(v) for v in a.names]).cast("string"))
        for bound in itertools.chain.from_iterable(itertools.combinations(both, k) for k in range(int(minus), len(both) + 1)):
            equal = [(F.col(v) if v in a.sure else F.coalesce(F.col(v), own)) == F.col(tag + v) for v in bound]
            free = [F.col(v).isNull() | F.col(tag + v).isNull() for v in both if v not in bound]
            df = df.join(right, functools.reduce(Column.__and__, [*equal, *free, *extra]), "left_anti")
        return df

    # patterns
    def group(self, elements: list, graph=None, given: Solution | None = None) -> Solution:
        now = given or self.unit()
        begun = given is not None
        filters, triples = [], []

        def flush():
            nonlocal now, begun
            for t in self.ordered(triples, now.names):
                one = self.triple(*t[1:], graph)
                now, begun = (self.join(now, one), True) if begun else (one, True)
            triples.clear()

        for e in elements:
            kind = e[0]
            if kind == "triple":
                triples.append(e)
                continue
            if kind == "filter":
                filters.append(e[1])
                continue
            flush()
            if kind == "optional":
                inner, conditions = [x for x in e[1] if x[0] != "filter"], [x[1] for x in e[1] if x[0] == "filter"]
                exists = [c for c in conditions if _has_exists(c)]
                plain = [c for c in conditions if not _has_exists(c)]
                right = self.group([*inner, *[("filter", c) for c in exists]], graph)
                now, begun = self.join(now, right, "left", plain), True
                continue
            if kind == "minus":
                right = self.group(e[1], graph)
                if set(now.names) & set(right.names):
                    now = self.join(now, right, "left_anti", minus=True)
                continue
            if kind == "bind":
                value = self.value(e[1], {v: F.col(v) for v in now.names}).token()
                now, begun = Solution(now.df.withColumn(e[2], value), now.sure, now.maybe | {e[2]}), True
                continue
            if kind == "union":
                parts = [self.group(x, graph) for x in e[1]]
                names = set().union(*[p.names for p in parts])
                df = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df for p in parts])
                one = Solution(df, set.intersection(*[p.sure for p in parts]), names)
            elif kind == "graph":
                one = self.group(e[2], e[1])
                if isinstance(e[1], Var) and e[1] not in one.names:  # an empty block: any graph
                    one = self.join(one, Solution(self.quads.select(F.col("g").alias(e[1])).distinct(), {e[1]}))
            elif kind == "group":
                one = self.group(e[1], graph)
            elif kind == "select":
                one = self.select(e[1], graph)
            elif kind == "values":
                rows = [tuple(r) for r in e[2]]
                schema = ", ".join(f"`{v}` string" for v in e[1])
                sure = {v for k, v in enumerate(e[1]) if all(r[k] is not None for r in rows)}
                one = Solution(self.spark.createDataFrame(rows, schema), sure, set(e[1]))
            else:
                raise ValueError(f"unknown pattern {kind}")
            now, begun = (self.join(now, one) if begun else one), True
        flush()
        for f in filters:
            now = self.filter(now, f, graph)
        return now

    def ordered(self, triples: list, known: list) -> list:
        """Connected patterns first, and of these the ones with the most constants."""
        left, out, known = list(triples), [], set(known)
        while left:
            def rank(t):
                names = {x for x in t[1:] if isinstance(x, Var)}
                constants = sum(not isinstance(x, Var) for x in (t[1], t[3])) * 2 + (not isinstance(t[2], (Var, tuple)))
                return (bool(known) and bool(names) and not names & known, isinstance(t[2], tuple), -constants)

            best = min(left, key=rank)
            left.remove(best)
            out.append(best)
            known |= {x for x in best[1:] if isinstance(x, Var)}
        return out

    def filter(self, now: Solution, e, graph) -> Solution:
        if e[0] == "&&":
            return self.filter(self.filter(now, e[1], graph), e[2], graph)
        negated = e[0] == "!" and e[1][0] == "exists"
        if negated or e[0] == "exists":
            inner = self.group((e[1] if negated else e)[1], graph)
            how = "left_anti" if negated else "left_semi"
            free = [x for x in self.inner_filters((e[1] if negated else e)[1]) if self.uses(x) & (set(now.names) - set(inner.names))]
            if free:  # a filter inside speaks of variables outside: it belongs to the condition
                body = [x for x in (e[1] if negated else e)[1] if not (x[0] == "filter" and x[1] in free)]
                return self.join(now, self.group(body, graph), how, free)
            return self.join(now, inner, how)
        if _has_exists(e):
            return self.marked(now, e, graph)
        return Solution(now.df.where(truth(self.value(e, {v: F.col(v) for v in now.names}))), now.sure, now.maybe)

    def marked(self, now: Solution, e, graph) -> Solution:
        """EXISTS below another operator: each becomes a column first."""
        marks = []

        def replace(x):
            if isinstance(x, tuple) and x and x[0] == "exists":
                marks.append((Var(f"__e{next(self.fresh)}"), x[1]))
                return ("var", marks[-1][0])
            return tuple(replace(y) for y in x) if isinstance(x, tuple) else [replace(y) for y in x] if isinstance(x, list) else x

        e = replace(e)
        for name, body in marks:
            keys = now.names
            inner = self.group(body, graph)
            hit = self.join(Solution(now.df.select(*keys).distinct(), now.sure, now.maybe), inner, "left_semi").df.withColumn(name, F.lit(T.literal(True)))
            joined = now.df.alias("l").join(hit.alias("r"), functools.reduce(Column.__and__, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], F.lit(True)), "left")
            df = joined.select(*[F.col(f"l.`{k}`").alias(k) for k in keys], F.coalesce(F.col(f"r.`{name}`"), F.lit(T.literal(False))).alias(name))
            now = Solution(df, now.sure | {name}, now.maybe)
        out = now.df.where(truth(self.value(e, {v: F.col(v) for v in now.names})))
        names = [n for n, _ in marks]
        return Solution(out.drop(*names), now.sure - set(names), now.maybe)

    def inner_filters(self, elements: list) -> list:
        return [x[1] for x in elements if x[0] == "filter" and not _has_exists(x[1])]

    def uses(self, e) -> set:
        if isinstance(e, Var):
            return {e}
        return set().union(*[self.uses(x) for x in e]) if isinstance(e, (tuple, list)) else set()

    # expressions
    def value(self, e, columns: dict[str, Column]) -> Value:
        kind = e[0]
        if kind == "var":
            return Value(columns[e[1]]) if e[1] in columns else Value(F.lit(None).cast("string"))
        if kind == "term":
            return Value(F.lit(e[1]), constant=e[1])
        if kind in ("||", "&&"):
            a, b = (truth(self.value(x, columns)) for x in e[1:])
            return Value(a | b if kind == "||" else a & b, "bool")
        if kind == "!":
            return Value(~truth(self.value(e[1], columns)), "bool")
        if kind == "in":
            a = self.value(e[1], columns)
            return Value(functools.reduce(Column.__or__, [compare("=", a, self.value(x, columns)) for x in e[2]], F.lit(False)), "bool")
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            return Value(compare(kind, self.value(e[1], columns), self.value(e[2], columns)), "bool")
        if kind in "+-*/":
            a, b = (self.value(x, columns) for x in e[1:])
            x, y = a.number(), b.number()
            out = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[kind]
            if kind == "/":
                return Value(out, "num", whole=F.lit(False))
            p, q = (v.exact().cast("decimal(38,0)") for v in (a, b))
            return Value(out, "num", whole=a.is_whole() & b.is_whole(), precise={"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[kind](p, q))
        if kind == "call":
            return call(e[1], [self.value(x, columns) for x in e[2]], e[2], columns)
        raise ValueError(f"unknown expression {kind}")

    # queries
    def select(self, q: Query, graph=None) -> Solution:
        given = None
        if self.bindings:
            given = Solution(self.spark.createDataFrame([tuple(self.bindings.values())], ", ".join(f"`{v}` string" for v in self.bindings)), set(self.bindings))
        now = self.group(q.where, graph, given)
        project = q.project
        if project is None:
            project = [(("var", Var(v)), Var(v)) for v in now.names if not v.startswith("_:")]
        order = q.order
        if q.group or any(_aggregates(e) for e, _ in project) or any(_aggregates(e) for e in q.having):
            now, project, order = self.aggregate(q, now, project)
        df = now.df
        # An earlier projected expression is visible to later ones and to ORDER BY.
        for e, v in project:
            if e != ("var", v):
                df = df.withColumn(v, self.value(e, {c: F.col(f"`{c}`") for c in df.columns}).token())
            elif v not in df.columns:
                df = df.withColumn(v, F.lit(None).cast("string"))
        columns = {c: F.col(f"`{c}`") for c in df.columns}
        keys = []
        for e, down in order:
            value = self.value(e, columns)
            for key in value.order_keys():
                keys.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        names = [v for _, v in project]
        if q.distinct:
            if all(e[0] == "var" and e[1] in names for e, _ in order):
                df = df.select(*names).distinct()
            else:
                df = df.dropDuplicates(names)
        if keys:
            df = df.orderBy(*keys)
        df = df.select(*names)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        sure = {v for e, v in project if e == ("var", v) and v in now.sure}
        return Solution(df, sure, set(names))

    def aggregate(self, q: Query, now: Solution, project: list):
        columns = {v: F.col(v) for v in now.names}
        keys = [(v, self.value(e, columns).token() if e != ("var", v) else columns.get(v, F.lit(None).cast("string"))) for e, v in q.group]
        found: dict = {}

        def replace(e):
            if isinstance(e, tuple) and e and e[0] == "aggregate":
                return ("var", found.setdefault(e, Var(f"__a{len(found)}")))
            if isinstance(e, tuple):
                return tuple(replace(x) for x in e)
            return [replace(x) for x in e] if isinstance(e, list) else e

        project = [(replace(_froze(e)), v) for e, v in project]
        having = [replace(_froze(e)) for e in q.having]
        order = [(replace(_froze(e)), d) for e, d in q.order]
        outs = [self.aggregated(e, columns).alias(v) for e, v in found.items()] or [F.count("*").alias("__none")]
        df = now.df.groupBy(*[c.alias(v) for v, c in keys]).agg(*outs)
        out = Solution(df, {v for v, _ in keys if v in now.sure} | set(found.values()), {v for v, _ in keys})
        for e in having:
            out = self.filter(out, e, None)
        return out, project, order

    def aggregated(self, e, columns) -> Column:
        _, name, distinct, arg, separator = e
        if arg is None:
            n = F.count_distinct(F.struct(*columns.values())) if distinct else F.count("*")
            return T.encode(n, "int")
        value = self.value(arg, columns)
        token = value.token()
        if name == "COUNT":
            return T.encode(F.count_distinct(token) if distinct else F.count(token), "int")
        if name in ("SUM", "AVG"):
            number = value.number()
            whole = F.coalesce(F.every(value.is_whole()), F.lit(True)) if name == "SUM" else F.lit(False)
            if name == "SUM":  # whole numbers add up exactly
                exact = value.exact().cast("decimal(38,0)")
                exact = F.coalesce(F.sum_distinct(exact) if distinct else F.try_sum(exact), F.lit(0).cast("decimal(38,0)"))
                return F.when(whole, T.encode(exact, "int")).otherwise(T.encode(F.sum_distinct(number) if distinct else F.sum(number), "num"))
            total = None if name == "SUM" else (F.avg(F.when(F.lit(True), number)) if not distinct else F.sum_distinct(number) / F.count_distinct(number))
            return Value(F.coalesce(total, F.lit(0.0)), "num", whole=whole).token()
        if name in ("MIN", "MAX"):
            best = (F.min if name == "MIN" else F.max)(F.when(token.isNotNull(), F.struct(*value.order_keys(), token.alias("t"))))
            return best["t"]
        if name == "SAMPLE":
            return F.min(token)
        text = value.string()
        return Value(F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(text)), separator), "str").token()

    def construct(self, template: list, solution: Solution) -> DataFrame:
        """Quads (g, s, p, o) of a template, without ill-formed ones; g is null outside GRAPH."""
        if not template:
            return self.spark.createDataFrame([], "g string, s string, p string, o string")
        names = solution.names
        row = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(v), F.lit("\x02")) for v in names]), 256) if names else F.lit("0")

        def column(t):
            if t is None:
                return F.lit(None).cast("string")
            if isinstance(t, Var):
                if t.startswith("_:") and t not in names:
                    return F.concat(F.lit("_:c"), F.substring(F.sha2(F.concat(row, F.lit(t)), 256), 1, 24))
                return F.col(t) if t in names else F.lit(None).cast("string")
            return F.lit(t)

        made = F.explode(F.array(*[F.struct(column(g).alias("g"), column(s).alias("s"), column(p).alias("p"), column(o).alias("o"), F.lit(g is not None).alias("named")) for g, s, p, o in template]))
        out = solution.df.select(made.alias("q")).select("q.*")
        good = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~T.is_literal(F.col("s")) & T.is_iri(F.col("p")) & (~F.col("named") | F.col("g").isNotNull())
        return once(out.where(good).select("g", "s", "p", "o"))

    def run(self, q: Query) -> DataFrame:
        """select: a column for each variable; construct and describe: (s, p, o); ask: one row with `ask`."""
        if q.dataset is not None:
            chosen = Compiler(self.spark, self.quads.where(F.col("g").isin(q.dataset[1]) if q.dataset[1] else F.lit(False)), self.bindings)
            chosen.default = self.default.where(F.col("g").isin(q.dataset[0]) if q.dataset[0] else F.lit(False))
            return chosen.run(dataclasses.replace(q, dataset=None))
        if q.form == "select":
            return self.select(q).df
        if q.form == "ask":
            return self.select(Query("select", where=q.where)).df.select(F.lit(True).alias("x")).limit(1).agg((F.count("*") > 0).alias("ask"))
        if q.form == "construct":
            inner = Query("select", where=q.where, order=q.order, limit=q.limit, offset=q.offset, group=q.group, having=q.having)
            return self.construct(q.template, self.select(inner) if q.limit is not None or q.offset or q.order else self.group(q.where, None, self.select(Query("select", where=[])) if self.bindings else None)).select("s", "p", "o").distinct()
        return self.describe(q)

    def describe(self, q: Query) -> DataFrame:
        """Concise bounded description: the triples of each resource, and of the blank nodes they lead to."""
        constants = [(t,) for t in q.project if not isinstance(t, Var)]
        wanted = self.spark.createDataFrame(constants, "s string")
        if q.where:
            found = self.group(q.where)
            for v in [t for t in q.project if isinstance(t, Var)]:
                wanted = wanted.unionByName(found.df.select(F.col(v).alias("s")))
        triples = self.default.select("s", "p", "o")
        edges = triples.where(T.is_blank(F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))
        reached = closure(edges, [], seeds=wanted.distinct()).select(F.col("b").alias("s"))
        return once(triples.join(wanted.unionByName(reached).distinct(), "s", "left_semi"))


def _froze(e):
    return tuple(_froze(x) for x in e) if isinstance(e, (list, tuple)) and not isinstance(e, str) else e


def _has_exists(e) -> bool:
    return isinstance(e, (tuple, list)) and bool(e) and (e[0] == "exists" or any(_has_exists(x) for x in e))


def _aggregates(e) -> bool:
    return isinstance(e, (tuple, list)) and bool(e) and (e[0] == "aggregate" or any(_aggregates(x) for x in e))
