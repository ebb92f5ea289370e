"""MinHash near-dedup by a multi-index Hamming join.

Each distinct shingle set gets a signature of 64 symbols of 16 bits, the low bits of 64 minima. The signature is cut into
16 chunks of 4 symbols. If two signatures differ in at most RADIUS = 31 symbols, some chunk differs in at most one
(31 < 2 * 16), so enumerating for each chunk the four ways to leave one symbol out gives every such pair a common key.
Two sets of Jaccard 0.75 differ in 16 symbols on average, with a deviation of 3.5; 31 is more than four deviations above.
Candidates within the radius are then checked on the full sets.

No bucket is expanded into all its pairs. First each member of a bucket is compared with the bucket's smallest member;
that joins groups of copies. Only buckets that still hold several components go on, and there only pairs of different
components are compared, in blocks of about SPLIT members and without a row for each pair. A pair that shares several
buckets is compared in the first of them. From a block go only pairs that can be links: each set's hashes are counted in bins,
and the sum of the smaller counts is never less than the intersection, so a pair whose sum is too small for 0.75 is none.

Defined results: a null or empty text, or one without words, has n_shingles 0 and is its own component. Rows of null
doc_id take no part: component_id is null and kept is true. Rows that share a doc_id are documents of their own, linked by
their texts alone. Columns other than doc_id and text are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_up_to, dropped, keep, mix, shingle_set, table
from trellis.llm.components import components

WORDS, SYMBOLS, CHUNKS, RADIUS = 5, 64, 16, 31
#: Members of a bucket in one block, rows of small buckets in one group, and the fewest and most bins of a set.
SPLIT, TOGETHER, BINS = 512, 4096, (256, 2048)
#: So many sets get their keys in one task.
KEYED = 8_192
#: An id table of up to so many rows (8 bytes each) is broadcast to pick documents.
BROADCAST_IDS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_S = _rng.integers(0, 2**64, SYMBOLS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 chunks (int64) of four 16-bit symbols each, of a set's hashes."""
    least = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(least, (x[at : at + 4096, None] * _A + _B).min(0), out=least)
    low = (mix(least.astype(np.uint64) ^ _S) >> np.uint64(48)).astype(np.uint16)
    return low.view(np.int64)


def _features(batches):
    for batch in batches:
        n, lo, hi, chunks = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, WORDS)
            n.append(len(s))
            lo.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            hi.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)) if len(s) else 0)
            chunks.append(signature(s) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(chunks, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "nid", "hi", "chunks"])


def _bins(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each bin; 255 stands for that many or more."""
    width = min(BINS[1], max(BINS[0], 1 << (len(s) * 3 // 2).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def _of_sets(kind: pa.DataType, what):
    """For mapInArrow, (nid, text) -> nid, found (the nid of the text's set), out (what is made of the set)."""
    def out(batches):
        for batch in batches:
            sets = [shingle_set(x, WORDS) for x in batch.column("text").to_pylist()]
            nid = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(nid, pa.int64()), pa.array([what(s) for s in sets], kind)], ["nid", "found", "out"])

    return out


def _keys(chunks: Column) -> Column:
    masks = [~(0xFFFF << 16 * j) for j in range(4)]
    masks = [m + 2**64 if m < -(2**63) else m for m in masks]
    return F.flatten(F.transform(chunks, lambda c, i: F.array(*[F.xxhash64(c.bitwiseAND(F.lit(m).cast("long")), i * 4 + j) for j, m in enumerate(masks)])))


def _keyed(nodes: DataFrame) -> DataFrame:
    """(at, key, nid): the 64 keys of each set. The sets are dealt out by their number first, for a task holds some 64 times what it reads."""
    spread = nodes.select("nid", "chunks").repartition(nodes.count() // KEYED + 1, "nid")
    return spread.select(F.posexplode(_keys(F.col("chunks"))).alias("at", "key"), "nid")


def _distance(a: Column, b: Column) -> Column:
    """In how many symbols two signatures differ."""
    def lanes(x: Column) -> Column:
        return sum((F.shiftrightunsigned(x, 16 * j).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int") for j in range(4))

    return F.aggregate(F.zip_with(a, b, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _near_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * 75


def _within(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and signatures are near enough."""
    side = [nodes.select(F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("chunks").alias(f"c{x}")) for x in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").where(_near_size(F.col("na"), F.col("nb"))).where(_distance(F.col("ca"), F.col("cb")) <= RADIUS).select("a", "b", "na", "nb")


def _read_sets(wanted: DataFrame, firsts: DataFrame, docs: DataFrame, column: str, of: Callable) -> DataFrame:
    """For the nids wanted, what is made of their sets, read again from the texts."""
    name, kind = column.split()
    wanted = keep(firsts.join(wanted, "nid").select("nid", "doc_id"), "op1-wanted")
    texts = docs.join(broadcast_up_to(wanted, BROADCAST_IDS), "doc_id").select("nid", "text")
    found = texts.mapInArrow(of, f"nid long, found long, out {kind}").where("nid = found").dropDuplicates(["nid"])
    out = keep(found.select("nid", F.col("out").alias(name)), f"op1-{name}")
    dropped(wanted)
    return out


def _confirmed(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, na, nb), those whose full sets have a Jaccard of 0.75 or more; a written table."""
    pairs = keep(pairs, "op1-candidates")
    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    sets = _read_sets(wanted, firsts, docs, "shingles array<long>", _of_sets(pa.list_(pa.int64()), lambda s: s.view(np.int64)))
    joined = pairs.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    out = keep(joined.where(both * 100 >= (F.col("na") + F.col("nb") - both) * 75).select(F.col("a").alias("u"), F.col("b").alias("v")), "op1-edges")
    dropped(pairs, sets)
    return out


def _first_bucket(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signature against many: in how many symbols each differs, and which of its keys is the first that both have (-1: none)."""
    differ = (b != a).reshape(len(b), CHUNKS, 4)
    wrong = differ.sum(2)
    chunk = (wrong <= 1).argmax(1)
    here = np.arange(len(b))
    first = chunk * 4 + differ[here, chunk].argmax(1)
    return wrong.sum(1), np.where(wrong[here, chunk] <= 1, first, -1)


def _most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many hashes are in both sets: one set's bins against those of many, of one width; the wider are folded."""
    least = min(len(a), b.shape[1])
    a, b = (x.reshape(-1, x.shape[-1] // least, least).sum(1, dtype=np.int32) if x.shape[-1] > least else x for x in (a[None], b))
    return np.minimum(a, b).sum(1, dtype=np.int64)


def _block_pairs(key: int, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """The pairs of two blocks of a bucket that are within the radius, of different components, first met here and possibly links."""
    a, b = (np.stack(x.chunks.to_list()).view(np.uint16).reshape(len(x), SYMBOLS) for x in (left, right))
    bins = [[np.frombuffer(h, np.uint8) for h in x.bins] for x in (left, right)]
    widths = np.array([len(h) for h in bins[1]])
    tables = {w: np.stack([h for h in bins[1] if len(h) == w]) for w in set(widths.tolist())}
    place = np.zeros(len(right), np.int64)
    for w in tables:
        place[widths == w] = np.arange((widths == w).sum())
    full = [np.array([h.max() == 255 for h in side]) for side in bins]
    comp, n, out_a, out_b = right.comp.to_numpy(), right.n.to_numpy(), [], []
    for k, (c, m, nid) in enumerate(zip(left.comp.tolist(), left.n.tolist(), left.nid.tolist())):
        near = (comp != c) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * 75)
        if same:
            near[: k + 1] = False
        hit = np.flatnonzero(near)
        distance, first = _first_bucket(a[k], b[hit])
        hit = hit[(distance <= RADIUS) & (first == key)]
        for w, table_ in tables.items():
            some = hit[widths[hit] == w]
            if len(some):
                both = _most(bins[0][k], table_[place[some]])
                some = some[full[0][k] | full[1][some] | (both * 100 >= (m + n[some] - both) * 75)]
                out_a += [nid] * len(some)
                out_b.append(right.nid.to_numpy()[some])
    one, two = np.array(out_a, np.int64), np.concatenate([np.zeros(0, np.int64), *out_b])
    return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of whole small buckets, or of two blocks of a bucket -> their pairs (a, b)."""
    found = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
    for (_, at, i, j), g in rows.groupby(["key", "at", "i", "j"]):
        left, right = g[g.block == i], g[g.block == j]
        if len(left) and len(right):
            found.append(_block_pairs(at, left, right, i == j))
    return pd.concat(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept, text_hash, root (of the text's component), for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    feats = keep(docs.mapInArrow(_features, "doc_id long, text_hash long, n long, nid long, hi long, chunks array<long>"), "op1-features")
    known = feats.where("n > 0 and doc_id is not null")
    nodes = keep(known.groupBy("nid", "hi").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("chunks").alias("chunks")), "op1-nodes")
    firsts = nodes.select("nid", "doc_id")
    keys = _keyed(nodes)
    buckets = keep(keys.groupBy("key", "at").agg(F.min("nid").alias("head"), F.count("*").alias("members")).where("members > 1"), "op1-buckets")
    members = keep(keys.join(buckets, ["key", "at"]), "op1-members")
    stars = members.where("nid <> head").select(F.col("head").alias("a"), F.col("nid").alias("b")).distinct()
    edges = _confirmed(_within(stars, nodes), firsts, docs)
    roots = keep(components(edges), "op1-roots")
    # What the stars leave open: buckets of three and more that still hold several components.
    open_ = members.where("members > 2").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("key", "at", "nid", "head", F.coalesce("root", "nid").alias("comp"))
    several = open_.groupBy("key", "at").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("members")).where("least <> most").select("key", "at", "members")
    open_ = keep(open_.where("nid <> head").join(several, ["key", "at"]).select("key", "at", "nid", "comp", "members"), "op1-open")
    dropped(buckets, members)
    bins = _read_sets(open_.select("nid").distinct(), firsts, docs, "bins binary", _of_sets(pa.binary(), _bins))
    rows = open_.join(nodes.select("nid", "n", "chunks").join(bins, "nid"), "nid")
    blocks = F.ceil(F.col("members") / SPLIT)
    deal = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("nid"), blocks)).withColumn("p", deal)
    groups = open_.where(F.col("members") <= SPLIT).count() // TOGETHER + 1
    group = F.when(F.col("members") <= SPLIT, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key"))
    dealt = dealt.select(group.alias("g"), "key", "at", "p.i", "p.j", "block", "nid", "comp", "n", "chunks", "bins")
    more = dealt.groupBy("g", "i", "j").applyInPandas(_compared, "a long, b long").where("a <> b").distinct()
    sizes = [nodes.select(F.col("nid").alias(s), F.col("n").alias(f"n{s}")) for s in "ab"]
    more = more.join(sizes[0], "a").join(sizes[1], "b")
    more = _confirmed(more, firsts, docs)
    dropped(open_, bins)
    if not more.isEmpty():
        roots = keep(components(edges.unionByName(more)), "op1-roots")
    root = nodes.select("nid", "hi", "doc_id").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "hi", "doc_id", F.coalesce("root", "nid").alias("root"))
    named = root.join(root.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("nid", "hi", "root", "component_id")
    rest = feats.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.col("text_hash").alias("root"))
    linked = known.join(named, ["nid", "hi"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "root")
    return linked.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash", "root")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with one of each group kept, all their columns. Rows that share a kept doc_id stay if their texts are of different
    components; of those of one, the text with the least hash stays, once. Rows without doc_id stay."""
    judged = keep(near_duplicates(docs), "op1-judged")
    gone = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    kept = judged.where("kept and doc_id is not null")
    repeated = not kept.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        least = kept.groupBy("doc_id", "root").agg(F.min("text_hash").alias("_least"))
        gone = gone.unionByName(kept.join(least, ["doc_id", "root"]).where("text_hash <> _least").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    found = (F.col("doc_id") == F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_hash"))
    out = docs.join(broadcast_up_to(gone.distinct(), BROADCAST_IDS), found, "left_anti")
    if not repeated:
        return out
    return out.where("doc_id is not null").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash").unionByName(out.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "root")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
