"""Line dedup by overlapping three-line windows.

Texts are cut at line feeds. Each run of three lines is hashed (128 bits); for each window that occurs more than once, in one text
or in several, the first occurrence stays (by doc_id with null last, the text's hash, position) and the lines of all later
ones are covered. Covered positions of a text are merged and those lines removed, but for lines of a first occurrence: one copy of every
repeated window stays.

Windows are counted with partial sums before the shuffle, and the join back splits hot windows, so a passage that a third of all
texts share is no task of its own. Positions are broadcast to the texts up to BROADCAST of them, and beyond joined by shuffle.

Defined results: null and empty texts, and those of fewer than three lines, have no window and stay as they are; windows of blank
lines alone don't count. Rows that share doc_id and text are one document, returned as often as they occur; rows that share only a
doc_id, or have none, are documents of their own. Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import keep, table

LINES, BROADCAST = 3, 500_000


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_lines, n_removed, text."""
    own = docs.select("doc_id", "text", F.split("text", "\n").alias("lines"), F.xxhash64("text").alias("t"))
    cut = own.where(F.size("lines") >= lines).select("doc_id", "t", "lines").withColumn("at", F.explode(F.sequence(F.lit(0), F.size("lines") - lines)))
    window = [F.get("lines", F.col("at") + j) for j in range(lines)]
    cut = cut.where(F.trim(F.concat(*window)) != "")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "at")
    windows = keep(cut.select(F.xxhash64(*window).alias("h1"), F.xxhash64(F.lit(1), *window).alias("h2"), place.alias("place")).distinct(), "op3-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = windows.join(first, ["h1", "h2"]).select("place.*", (F.col("place") > F.col("first")).alias("later"))
    ats = [F.sort_array(F.collect_list(F.when(F.col("later") == x, F.col("at")))).alias(n) for n, x in (("starts", True), ("firsts", False))]
    covered = repeated.groupBy("doc_id", "t").agg(*ats).where(F.size("starts") > 0).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "starts", "firsts")
    covered = keep(covered, "op3-covered")
    few = (covered.agg(F.sum(F.size("starts") + F.size("firsts") + 1)).first()[0] or 0) <= BROADCAST
    joined = own.join(F.broadcast(covered) if few else covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    at = lambda x: F.flatten(F.transform(x, lambda s: F.sequence(s, s + (lines - 1))))
    gone = F.array_except(at("starts"), at("firsts"))
    out = joined.withColumn("gone", gone)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.when(F.coalesce(F.size("gone"), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i AS pos, array_to_string(lines[i + 1:i + 3], chr(10)) AS win, array_to_string(lines[i + 1:i + 3], '') AS flat
  FROM (SELECT *, unnest(range(0, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n, count(*) OVER (PARTITION BY win) AS many FROM w WHERE trim(flat, ' ') <> ''),
c AS (SELECT doc_id, pos + unnest([0, 1, 2]) AS line FROM r WHERE n > 1 EXCEPT SELECT doc_id, pos + unnest([0, 1, 2]) FROM r WHERE n = 1 AND many > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(gone, i)], chr(10)) END AS text
FROM l LEFT JOIN g ON g.doc_id = l.doc_id
"""
