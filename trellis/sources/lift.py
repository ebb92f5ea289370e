"""Relational tables as quads, by a declarative mapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.terms import TYPE, encode, encode_iri

_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "num", "float": "num", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ntz", "string": "str"}


def ref(prefix: str, column: str) -> Column:
    """An IRI made of a prefix and a key."""
    return F.when(F.col(column).isNotNull(), encode_iri(F.concat(F.lit(prefix), F.col(column).cast("string"))))


def lift(table: DataFrame, graph: Column | str, subject: Column, properties: Mapping[str, str | Column], cls: str | None = None) -> DataFrame:
    """One quad for each row and property that is not null. properties: predicate IRI -> a column's name, encoded by its type, or a
    column of tokens. graph: an IRI or a column of tokens. All quads come from one pass over the table."""
    kinds = dict(table.dtypes)
    pairs = [F.struct(F.lit(TYPE).alias("p"), F.lit(f"<{cls}>").alias("o"))] if cls else []
    for predicate, value in properties.items():
        token = encode(F.col(value), _KINDS[kinds[value]]) if isinstance(value, str) else value
        pairs.append(F.struct(F.lit(f"<{predicate}>").alias("p"), token.alias("o")))
    g = F.lit(f"<{graph}>") if isinstance(graph, str) else graph
    rows = table.select(g.alias("g"), subject.alias("s"), F.explode(F.array(*pairs)).alias("t"))
    return rows.select("g", "s", "t.p", "t.o").where("o is not null")
