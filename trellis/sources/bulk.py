"""N-Triples and N-Quads at scale: line files read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
QUADS = "g string, s string, p string, o string"


def read_lines(spark: SparkSession, path: str, graph: str | None = None, strict: bool = True) -> DataFrame:
    """Line files -> quads; lines without a graph go to `graph` (an IRI). Blank lines and comments are left out; any other line that is
    no statement raises when it is read, or is left out if not strict."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(_LINE)
    lines = lines.select(F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), "value"))).alias("value")) if strict else lines.where(good)
    part = lambda k: F.regexp_extract("value", _LINE, k)
    g = F.when(part(4) != "", part(4)).otherwise(F.lit(f"<{graph}>" if graph else None))
    return lines.select(g.alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def write_lines(quads: DataFrame, path: str, graphs: bool = True) -> None:
    quads.select(F.concat_ws(" ", "s", "p", "o", *(["g"] if graphs else []), F.lit("."))).write.text(path)
