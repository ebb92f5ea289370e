"""Benchmark decontamination by SimHash windows [DataFrame functions only].

1. Shingles of five words (items shorter than that: the item as one shingle of its own length) are hashed at every position
   of every text; only windows that share a shingle with some item can be similar to one, so positions are joined with
   the items' shingles and all windows around the hits are built, each as large as the item.
2. Windows and items get 64-bit SimHash fingerprints. Further occurrences of a shingle count as hashes of their own, so the
   weighted similarity of the bags is that of sets. Two sets of one size with a Jaccard of 0.75 differ in 11 bits on average, with a deviation of 3; RADIUS = 23 is four deviations above. The fingerprint is cut into eight bytes: of
   two within 23 bits, some byte differs in at most two (23 < 3 * 8), so the items' bytes are joined with all 37 variants
   of up to two flipped bits. That gives every pair within the radius.
3. Pairs within the radius are verified: the exact weighted similarity of the bags of shingles (each shingle weighs as often
   as it occurs) must be 0.75 or more. The best window of each text and item is reported.

The items' shingles are broadcast up to BROADCAST rows and joined by shuffle beyond. Windows of equal texts are built once.

Defined results: null or empty texts and items, and items of null item_id, match nothing. Texts shorter than an item are one window.
Rows that share a doc_id or have none are judged by their own text and reported under that doc_id. Repeated items are each
reported. Of windows that tie, the first. Bags of over 65,535 shingles skip step 2 and are verified directly. Other columns are ignored, whatever
their names. Empty tables give an empty result."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_up_to, keep, lower_az, table

WORDS, RADIUS, BYTES, FLIPS, BROADCAST, LANE = 5, 23, 8, 2, 1_000_000, 65_535
_LANES = 0x0001000100010001
_FLIPPED = [sum(1 << b for b in at) for k in range(FLIPS + 1) for at in combinations(range(8), k)]


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(lower_az(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _shingles(words: str, k: int) -> Column:
    """The hashes of k words from each position of the column words; empty if there are fewer words."""
    w = F.col(words)
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(bag: Column) -> Column:
    """64 bits: each set where most of the tagged bag's hashes have it, so a repeated shingle is as many votes of its own."""
    return _once(F.when(F.size(bag) <= LANE, _tagged(bag)).otherwise(bag), _majority)


def _majority(bag: Column) -> Column:
    """Each of 64 bits that most of the hashes have. Four counters of 16 bits share a long."""
    n = F.size(bag)
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.aggregate(bag, F.lit(0).cast("long"), lambda s, h: s + _shift(h, j).bitwiseAND(F.lit(_LANES))))
    bits = F.transform(sums, lambda s: F.array(*[((F.shiftrightunsigned(s, 16 * k).bitwiseAND(F.lit(0xFFFF)) * 2) > n).cast("long") for k in range(4)]))
    return F.aggregate(F.transform(bits, lambda b, j: F.aggregate(F.transform(b, lambda x, k: _left(x, j + k * 16)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by.cast("int"))


def _left(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def _tagged(bag: Column) -> Column:
    """The bag as a set: further occurrences of a hash become hashes of their own."""
    def of_sorted(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), F.xxhash64(x, i - F.array_position(s, x) + 1)).otherwise(x))

    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), bag).otherwise(_once(F.sort_array(bag), of_sorted))


def _once(x: Column, f) -> Column:
    """f(x), x being computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _byte(fp: Column, at: Column) -> Column:
    return _shift(fp, at * 8).bitwiseAND(F.lit(255).cast("long"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, similarity, start, words, and the text's hashes t1, t2."""
    read = items.where("item_id is not null").select("item_id", _words(F.col("text")).alias("w")).where("w is not null").withColumn("k", F.least(F.lit(WORDS), F.size("w")))
    sizes = sorted({WORDS, *(r[0] for r in read.where(F.col("k") < WORDS).select("k").distinct().collect())})  # at most five
    bag = F.coalesce(*[F.when(F.col("k") == k, _shingles("w", k)) for k in sizes])
    bags = keep(read.withColumn("bag", bag).select("item_id", "k", "bag", F.size("bag").alias("m"), _fingerprint(F.col("bag")).alias("fp")), "op4-items")
    wanted = broadcast_up_to(bags.select("k", F.explode("bag").alias("h"), "m").distinct(), BROADCAST)
    whole = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    texts = whole.select("doc_id", "t1", "t2", _words(F.col("text")).alias("w")).where("w is not null")
    found = None
    for k in sizes:
        some = texts.select("doc_id", "t1", "t2", F.posexplode(_shingles("w", k)).alias("pos", "h")).join(wanted.where(F.col("k") == k), "h")
        found = some if found is None else found.unionByName(some)
    found = keep(found, "op4-hits")
    owners = found.select("doc_id", "t1", "t2").distinct()
    # The texts that were hit, once each, with all their shingles.
    hit = keep(owners.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("_null")), "op4-texts")
    again = whole.join(broadcast_up_to(hit.select("t1", "t2"), BROADCAST), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).select("t1", "t2", _words(F.col("text")).alias("w"))
    lines = None
    for k in sizes:
        some = again.select("t1", "t2", F.lit(k).alias("k"), _shingles("w", k).alias("line"))
        lines = some if lines is None else lines.unionByName(some)
    spots = found.groupBy("t1", "t2", "k", "m").agg(F.array_distinct(F.flatten(F.collect_set(F.array("pos")))).alias("spots"))
    starts = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(F.greatest(F.lit(0), F.least(p - F.col("m") + 1, F.size("line") - F.col("m"))), F.greatest(F.lit(0), F.least(p, F.size("line") - F.col("m")))))))
    cut = spots.join(lines, ["t1", "t2", "k"]).select("t1", "t2", "k", "m", "line", F.explode(starts).alias("start"))
    windows = cut.select("t1", "t2", "k", "m", "start", F.slice("line", F.col("start") + 1, F.col("m")).alias("win")).withColumn("wfp", _fingerprint(F.col("win")))
    # Multi-index join: bytes of windows against the variants of the items' bytes. At -1, what is too long for the counters.
    at = F.when(F.col("m") > LANE, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(BYTES - 1)))
    asked = windows.withColumn("at", F.explode(at)).withColumn("byte", F.when(F.col("at") < 0, 0).otherwise(_byte(F.col("wfp"), F.greatest(F.col("at"), F.lit(0)))))
    flips = F.array(*[F.lit(x).cast("long") for x in _FLIPPED])
    offered = bags.select("item_id", "k", "m", "fp", "bag", F.explode(at).alias("at"))
    offered = offered.withColumn("byte", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(flips, lambda x: x.bitwiseXOR(_byte(F.col("fp"), F.greatest(F.col("at"), F.lit(0))))))))
    near = asked.join(offered.select("item_id", "k", "m", "fp", "at", "byte"), ["k", "m", "at", "byte"]).where((F.col("at") < 0) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))) <= RADIUS))
    near = near.dropDuplicates(["t1", "t2", "k", "m", "start", "item_id", "fp"]).join(bags.select("item_id", F.col("bag").alias("bag"), F.col("k").alias("_k"), F.col("m").alias("_m"), F.col("fp").alias("_fp")), ["item_id"]).where("k = _k and m = _m and fp = _fp")
    both = F.size(F.array_intersect(_tagged(F.col("win")), _tagged(F.col("bag"))))
    near = near.withColumn("both", both).withColumn("all", F.size("win") + F.col("m") - F.col("both")).where(F.col("both") * 100 >= F.col("all") * 75)
    best = near.groupBy("t1", "t2", "item_id").agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"), (F.col("m") + F.col("k") - 1).alias("words"))).alias("b"))
    out = owners.join(best, ["t1", "t2"])
    return out.select("doc_id", "item_id", "b.similarity", (-F.col("b.start")).cast("long").alias("start"), F.col("b.words").cast("long").alias("words"), "t1", "t2")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents whose text has no window like an item; all their columns."""
    dirty = keep(matches(docs, items).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct(), "op4-dirty")
    hashed = docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    found = (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2")) & F.col("text").isNotNull()
    return hashed.join(broadcast_up_to(dirty, BROADCAST), found, "left_anti").select(*[docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t1", "t2")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s, len(w) - 4 AS m FROM (SELECT *, unnest(range(0, len(w) - 4)) AS pos FROM i WHERE len(w) >= 5)),
d AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s, len(w) - 4 AS n FROM (SELECT *, unnest(range(0, len(w) - 4)) AS pos FROM t WHERE len(w) >= 5)),
h AS (SELECT DISTINCT d.doc_id, d.n, d.pos, b.item_id, b.m FROM d JOIN b ON b.s = d.s),
c AS (SELECT DISTINCT doc_id, item_id, m, n, unnest(range(greatest(0, least(pos - m + 1, n - m)), greatest(0, least(pos, n - m)) + 1)) AS start FROM h),
f AS (SELECT c.doc_id, c.item_id, c.start, c.m, c.n, d.s, count(*) AS k FROM c JOIN d ON d.doc_id = c.doc_id AND d.pos >= c.start AND d.pos < c.start + c.m GROUP BY ALL),
g AS (SELECT item_id, s, count(*) AS k FROM b GROUP BY ALL),
x AS (SELECT f.doc_id, f.item_id, f.start, f.m, f.n, sum(least(f.k, g.k)) AS inter FROM f JOIN g ON g.item_id = f.item_id AND g.s = f.s GROUP BY ALL),
y AS (SELECT *, inter / (least(m, n) + m - inter) AS similarity FROM x WHERE 100 * inter >= 75 * (least(m, n) + m - inter))
SELECT doc_id, item_id, similarity, start::BIGINT AS start, (m + 4)::BIGINT AS words
FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
