"""RDFS entailment: domain, range, subproperty and subclass rules. The schema is read once and its closures are computed first, then
one pass of joins with these small tables over the instance data: inheritance of properties, then domain and range, then of types;
repeated triples drop out once, at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.terms import RDFS, TYPE, is_literal
from trellis.operators.distinct import once
from trellis.operators.fixpoint import SMALL, closure
from trellis.storage import written


def entailed(triples: DataFrame) -> DataFrame:
    """(s, p, o) -> the RDFS closure, what was given included."""
    t = triples.select("s", "p", "o")
    rules = written(t.where(F.col("p").isin(*[f"<{RDFS}{x}>" for x in ("subClassOf", "subPropertyOf", "domain", "range")])), "schema")

    def pairs(name: str) -> DataFrame:
        return rules.where(F.col("p") == f"<{RDFS}{name}>").select(F.col("s").alias("a"), F.col("o").alias("b"))

    sub_class, sub_property = (closure(pairs(x)) for x in ("subClassOf", "subPropertyOf"))
    # few rules go to all tasks; else the facts would be dealt by predicate, of which there are few
    small = F.broadcast if rules.count() <= SMALL else lambda x: x
    facts = t.unionByName(t.join(small(sub_property.withColumnRenamed("a", "p")), "p").select("s", F.col("b").alias("p"), "o"))
    typed = [facts.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))]
    for name, column in (("domain", "s"), ("range", "o")):
        rule = pairs(name).withColumnRenamed("a", "p")
        typed.append(facts.join(small(rule), "p").where(~is_literal(F.col(column))).select(F.col(column).alias("s"), F.col("b").alias("c")))
    types = typed[0].unionByName(typed[1]).unionByName(typed[2])
    types = types.unionByName(types.join(small(sub_class.withColumnRenamed("a", "c")), "c").select("s", F.col("b").alias("c")))
    schema = [x.select(F.col("a").alias("s"), F.lit(f"<{RDFS}{name}>").alias("p"), F.col("b").alias("o")) for x, name in ((sub_class, "subClassOf"), (sub_property, "subPropertyOf"))]
    return once(facts.unionByName(types.select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))).unionByName(schema[0]).unionByName(schema[1]))


def inferred(triples: DataFrame, own: DataFrame) -> DataFrame:
    """What follows from triples and is not in own."""
    return entailed(triples).join(own.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
