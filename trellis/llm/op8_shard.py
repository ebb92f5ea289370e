"""Sharding by a hierarchical weighted hash tree.

A topology is a list of leaves (region, rack, shard, weight). A document descends from regions to racks to shards; at each level
every child draws an exponential variable from a hash of the document's id and the child's path, divided by the weight of
the child's subtree, and the smallest draw wins. So a child is taken in proportion to its weight, and if weights change, rows
move only into or out of the subtrees whose weights change.

topology(n): BASE shards in regions of 12 and racks of 4; each further shard is a region of its own. So the law is `key`: doc_id
and shard count decide, and one more shard takes rows only into itself.

The slot of a row counts the rows before it in its shard, by random bits of its id and text: ranges of these bits are counted apart
and only their counts meet, so a shard may hold any number of rows.

Defined results: null doc_ids go by the hash of the empty name; a null text has 8 bytes (none plus 8) and the CRC of the empty text;
rows that repeat go to one shard, with a slot each. Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import hash_bits, keep, prefix_sums, table

SHARDS, BASE, PER_RACK, PER_REGION = 24, 24, 4, 12


def topology(shards: int, base: int = BASE) -> list[tuple[str, str, int, float]]:
    tree = [(f"r{s // PER_REGION}", f"k{s // PER_RACK}", s, 1.0) for s in range(min(shards, base))]
    return tree + [(f"x{s}", f"x{s}", s, 1.0) for s in range(min(shards, base), shards)]


def _children(leaves: list, depth: int) -> list[list[tuple[str, float, int]]]:
    """For each node at depth, in order of its path: path, weight and number of each child."""
    nodes: dict[tuple, dict[tuple, float]] = {(): {}} if not depth else {}
    below = list(dict.fromkeys(x[: depth + 1] for x in leaves))
    for leaf in leaves:
        own = nodes.setdefault(leaf[:depth], {})
        own[leaf[: depth + 1]] = own.get(leaf[: depth + 1], 0.0) + leaf[3]
    return [[("/".join(map(str, path)), weight, path[2] if depth == 2 else below.index(path)) for path, weight in own.items()] for own in nodes.values()]


def place(doc_id: Column, leaves: list[tuple[str, str, int, float]]) -> Column:
    """The shard of an id in a tree. A draw is an exponential variable whose rate is the child's weight, made of a hash: the
    first 48 bits of an MD5 as a number between 0 and 1."""
    leaves = [x for x in leaves if x[3] > 0]
    node, name = F.lit(0), F.coalesce(doc_id.cast("string"), F.lit(""))
    for depth in range(3):
        children = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(k).alias("node")) for p, w, k in own]) for own in _children(leaves, depth)])

        def draw(child: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat(child["path"], F.lit(":"), name)), 1, 12), 16, 10).cast("double")
            return F.struct((-F.log((bits + 0.5) / float(2**48)) / child["weight"]).alias("draw"), child["node"].alias("node"))

        node = F.array_min(F.transform(F.get(children, node), draw))["node"]
    return node.cast("int")


def _placed(docs: DataFrame, shards: int) -> DataFrame:
    """docs with size, text_crc32, law, shard, grown_shard and _bits."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"size": F.length(raw).cast("long") + 8, "text_crc32": F.crc32(raw), "law": F.lit("key"), "shard": place(F.col("doc_id"), topology(shards)), "grown_shard": place(F.col("doc_id"), topology(shards + 1)), "_bits": hash_bits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(raw)), "slot:")})


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = _placed(docs.select("doc_id", "text"), shards).drop("text")
    placed = keep(placed, "op8-placed")
    slotted = prefix_sums(placed, "shard", "_bits", ["doc_id", "text_crc32"], F.lit(1), "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs under path, one folder a shard; a shard may have many files."""
    docs.withColumn("shard", place(F.col("doc_id"), topology(shards))).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB: one table of all nodes of both trees, from the root down; CRC-32 by its table, which eight shifts a byte make."""
    nodes = []
    for tree, shards in ((0, SHARDS), (1, SHARDS + 1)):
        for depth in range(3):
            for parent, own in enumerate(_children(topology(shards), depth)):
                nodes += [f"({tree}, {depth}, {parent}, '{path}', {weight}, {node})" for path, weight, node in own]
    steps = []
    for depth in range(3):
        above = "SELECT *, t.tree, 0 AS node FROM d, (VALUES (0), (1)) t(tree)" if not depth else f"SELECT * FROM l{depth - 1}"
        steps.append(f"""l{depth} AS (
  SELECT a.n, a.doc_id, a.hash, a.size, a.crc, a.tree, arg_min(c.node, -ln((('0x' || substr(md5(c.path || ':' || coalesce(a.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / c.weight) AS node
  FROM ({above}) a JOIN nodes c ON c.tree = a.tree AND c.depth = {depth} AND c.parent = a.node GROUP BY ALL)""".replace("SELECT *, t.tree", "SELECT d.*, t.tree"))
    return f"""
WITH bytes AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc_of FROM range(256) t(b)),
d AS (
  SELECT row_number() OVER () AS n, doc_id, md5(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, crc_of[1 + xor(c % 256, b)])), 4294967295) AS crc
  FROM documents, bytes),
nodes(tree, depth, parent, path, weight, node) AS (VALUES {", ".join(nodes)}),
{", ".join(steps)}
SELECT a.doc_id, a.size, a.crc AS text_crc32, 'key' AS law, a.node::INTEGER AS shard,
  row_number() OVER (PARTITION BY a.node ORDER BY substr(md5('slot:' || coalesce(a.doc_id::VARCHAR, '') || ':' || a.hash), 1, 12), a.doc_id, a.crc) - 1 AS slot, b.node::INTEGER AS grown_shard
FROM l2 a JOIN l2 b ON a.n = b.n AND a.tree = 0 AND b.tree = 1
"""


SQL = _sql()
