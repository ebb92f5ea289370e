"""Mixing sources to target weights.

Documents get hash-random keys, are ranged by key within each source, and running sums of their word counts are built from
the sums of the ranges, so a source that holds most rows is spread over many tasks. Each source is cut at its exact
budget: whole epochs first, then the documents whose words come before the remaining budget; the document at the cut gives
the words up to it. The only rows that meet in one place are one per source.

Targets: the sources, by code point with null last, weigh WEIGHTS in turn and share the words of all documents; a target is at
most MOST times its source's size, and what is above goes to the others by weight until none is above. That is one
level L with target = least(MOST * size, L * weight), found by going through the sources in order of size / weight.

Keys are a hash of doc_id and text, so rows without doc_id, or that share one, are spread like others.

Defined results: a null or empty text has size 0 and takes 0. A null source is a source of its own. Null and repeated doc_ids
are documents of their own; rows that share source, doc_id and text have one key and are interchangeable: as many of them are taken in
every run. A source without words has target 0.
Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import hash_bits, keep, n_words, prefix_sums, table

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1:"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with one row per source -> the same with target."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    # In order of cap / weight: the first is above its cap if the level of what is left, shared by the weights left, is above that ratio.
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest)
    tried = weighed.withColumn("_level", level).withColumn("_over", F.col("_level") * F.col("_w") > F.col("_cap"))
    at = F.min(F.when(~F.col("_over"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("source").isNull(), F.col("source").cast("binary"), F.col("_level").alias("level")))).over(every)
    return tried.withColumn("_at", at["level"]).select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


def _taken(size: Column, before: Column, source_size: Column, target: Column) -> Column:
    budget = F.floor(target)
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0)
    left = budget - epochs * source_size
    return (epochs * size + F.greatest(F.lit(0), F.least(size, left - before))).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, row: str | None = None) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, and the column row if one is named."""
    own = [F.col(row).alias("_row")] if row else []
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    sized = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_bits(key, seed).alias("_key"), *own), "op2-sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    shares = keep(shares, "op2-targets").withColumnRenamed("source", "_of")
    running = prefix_sums(sized, "source", "_key", ["doc_id", "size", *(["_row"] if row else [])], F.col("size"), "before")
    out = running.join(shares, F.col("source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("before"), F.col("source_size"), F.col("target")).alias("taken"), *([F.col("_row").alias(row)] if row else []))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands there."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n.cast("int")), "")


def _written(joined: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows with _size and _taken -> each as often as it is taken whole, and its first words once more; without words, as it is."""
    usual = F.col("_size") > 0
    whole = F.when(usual, F.floor(F.col("_taken") / F.col("_size"))).otherwise(F.lit(1))
    part = F.when(usual, F.col("_taken") % F.col("_size")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    dealt = joined.withColumn("_words", F.explode(copies))
    text = F.when(F.col("_words") >= 0, first_words(F.col("text"), F.col("_words"))).otherwise(F.col("text"))
    out = dealt.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_words") >= 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, all columns of docs: each row as often as it is taken whole, and the one at a cut once more with its first words.

    Rows get numbers that are written once, and each its own count, whatever their doc_ids. Rows of one doc_id and text that differ in other
    columns are taken in order of a hash of all columns.

    Documents without words have no share in any target and are written once."""
    numbered = keep(docs.withColumn("_number", F.struct(F.xxhash64(*docs.columns).alias("h"), F.monotonically_increasing_id().alias("n"))), "op2-rows")
    counts = mix(numbered, row="_number").select(F.col("_number").alias("_of"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    return _written(numbered.join(counts, F.col("_number") == F.col("_of")), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
a AS (SELECT level FROM l WHERE level * w <= 3 * source_size ORDER BY 3 * source_size / w, source IS NULL, encode(source) LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM a) * w, (3 * source_size)::DOUBLE)) AS target FROM l),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t)
SELECT r.doc_id, r.size, e.source_size, e.target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
