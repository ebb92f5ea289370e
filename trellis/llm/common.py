"""Helpers that the operators share: tables in the shared folder, words, shingle hashes, positions."""

from __future__ import annotations

import contextlib
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.storage import drop_at_exit, drop_folder, shared_dir

#: What separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: While a table is written: shuffle files go once the table is there, and Python gets few rows at a time, for texts may be long.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.compression.codec": "zstd"}


#: Where the tables of keep() are, by the frame that reads them.
_kept: dict[int, tuple[str, str | None]] = {}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Sets session options, and puts back what was there."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keep(df: DataFrame, label: str, buckets: tuple[str, int] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor takes nothing with it.

    buckets: a column and a number; the table is bucketed by it, so that joins and groups by that column need no shuffle of it."""
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with settings(spark, _WHILE_WRITING):
        if buckets:
            name = name.replace("-", "_")
            df.write.bucketBy(buckets[1], buckets[0]).option("path", path).saveAsTable(name)
        else:
            df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.table(name) if buckets else spark.read.schema(df.schema).parquet(path)
    _kept[id(out)] = (path, name if buckets else None)
    weakref.finalize(out, _kept.pop, id(out), None)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that keep() wrote, once nothing reads them any more."""
    for df in tables:
        path, name = _kept.pop(id(df), (None, None))
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            drop_folder(df.sparkSession, path)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, mod: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 2, F.lit(False))


def hash_bits(doc_id: Column, seed: str) -> Column:
    """48 random bits of an id, the same in every run: the first twelve hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def prefix_sums(df: DataFrame, group: str, bits: str, order: list[str], value: Column, out: str, per_bucket: int = 1_000) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in its group, in order of the column bits (48 random bits), then order.

    Groups are cut into ranges of bits, about per_bucket rows each, so one group may hold most rows: only the sums of
    the ranges meet in one place. A null group is a group. Rows equal in bits and order come in any order."""
    from pyspark.sql import Window as W

    count, total = f"{out}_rows", f"{out}_sum"
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.lit(1), F.least(F.lit(32_767), F.ceil(F.count("*") / per_bucket))).alias(count))
    cut = df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    cut = cut.withColumn("_range", F.shiftright(F.col(bits) * F.col(count), 48)).drop(count)
    sums = cut.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum(value).alias(total))
    before = F.sum(total).over(W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_g", "_r", F.coalesce(before, F.lit(0)).alias(total))
    within = F.sum(value).over(W.partitionBy(group, "_range").orderBy(bits, *order).rowsBetween(W.unboundedPreceding, -1))
    joined = cut.withColumn(out, F.coalesce(within, F.lit(0))).join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(out, F.col(out) + F.col(total)).drop("_g", "_r", "_range", total)


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(2**63, 2**64, dtype=np.uint64)) | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The powers of base modulo 2^64, at least n of them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        grown[0] = 1
        _powers[name] = have = np.multiply.accumulate(grown)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_spans(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words (A-Z only) joined by single spaces, and where each begins and ends."""
    joined = b" ".join(text.encode("utf-8", "replace").lower().split()) if text else b""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    none = not joined
    return joined, np.concatenate([np.zeros(0 if none else 1, np.int64), gaps + 1]), np.concatenate([gaps, np.full(0 if none else 1, len(joined), np.int64)])


def span_hashes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices, by one running sum over the bytes."""
    a = np.frombuffer(joined, np.uint8)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _power("up", _BASE, len(a) + 1)[: len(a)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * _power("down", _BACK, len(a) + 1)[begin])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; of fewer words, the whole sequence as one; of none, nothing."""
    joined, begin, end = word_spans(text)
    if not len(begin):
        return np.zeros(0, np.uint64)
    k = min(words, len(begin)) - 1
    return np.unique(span_hashes(joined, begin[: len(begin) - k], end[k:]))
