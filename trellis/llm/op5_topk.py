"""Exact top-k inner products over norm-sorted vectors, with SVD-rotated partial sums.

The vectors' Gram matrix, summed over all rows, gives the rotation that puts most of their energy into the first
coordinates. All vectors are put into blocks by descending length (a range of lengths a block, by a distributed sort). A pass
over the longest vectors gives each query a floor: its k-th best score so far. Then each block of queries meets each block of
vectors: pairs of block numbers are pruned first, by the product of the largest lengths against the lowest floor, and only
then are the blocks joined to what is left of the pairs. Inside a block, rows whose
partial sum over the first coordinates plus the product of the residual lengths (Cauchy-Schwarz) is below the floor are
left out before the full product. Scores are integer and exact; each pair of blocks gives at most k rows a query.

Defined results: components become floor(64 * x). Rows with a null vec_id, a null vector, or null or non-finite components take
no part. Vectors of different lengths have no product. Every row has a number of its own: a query is paired with every row but itself, and ranked
by itself, so rows that repeat or share a vec_id have ranks 1 to k each. Ties go to the smaller vec_id. Products are 64-bit: components up to
some 10^8 are safe. Empty vectors score 0. Other columns are ignored, whatever their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_up_to, hash_bits, keep, table

K, EVERY, SCALE, BLOCK, QUERIES, LEAD, HEAD = 20, 20, 64, 4096, 512, 16, 1024
#: So many block numbers (some 20 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST = 500_000


def _integers(rows: DataFrame) -> DataFrame:
    good = rows.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return good.select("vec_id", "row", "asked", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")).withColumn("dim", F.size("v"))


def _gram(batches):
    """Partial Gram matrices, as (dim, row, values): a row for each coordinate."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for dim, g in pdf.groupby("dim"):
            m = np.stack(g.v.to_list()).astype(np.float64) if dim else np.zeros((len(g), 0))
            sums[dim] = sums.get(dim, 0) + m.T @ m
    for dim, s in sums.items():
        for i in range(dim):
            yield pd.DataFrame({"dim": dim, "row": i, "col": np.arange(dim), "s": s[i]})


def _blocks(groups: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block as bytes: ids, integer vectors."""
    g = groups.sort_values(["norm", "vec_id", "row"], ascending=[False, True, True])
    v = np.stack(g.v.to_list()) if g.dim.iloc[0] else np.zeros((len(g), 0), np.int64)
    kind = np.int16 if not v.size or np.abs(v).max() < 2**15 else np.int64
    return pd.DataFrame({"dim": [g.dim.iloc[0]], "block": [g.block.iloc[0]], "top": [float(g.norm.max())], "rows": [len(g)], "wide": [kind is np.int64], "ids": [g.vec_id.to_numpy(np.int64).tobytes()], "numbers": [g.row.to_numpy(np.int64).tobytes()], "data": [v.astype(kind).tobytes()]})


_BLOCK = "dim int, block long, top double, rows int, wide boolean, ids binary, numbers binary, data binary"
_HITS = "query long, query_id long, vec_id long, score long"


def _read(ids: bytes, data: bytes, dim: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.int64 if wide else np.int16).astype(np.int64).reshape(len(ids), dim)


def _scan(rotations: dict, k: int):
    def scan(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qi, q = _read(r.q_ids, r.q_data, r.dim, r.q_wide)
                ci, c = _read(r.ids, r.data, r.dim, r.wide)
                q_row, c_row = np.frombuffer(r.q_numbers, np.int64), np.frombuffer(r.numbers, np.int64)
                floors = np.asarray(r.floors, np.float64) if r.floors is not None else np.full(len(qi), -np.inf)
                exact = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0) * (c.astype(float) ** 2).sum(1).max(initial=0)) < 2**52
                qf, cf = q.astype(np.float64), c.astype(np.float64)
                qr, cr = qf @ rotations[r.dim], cf @ rotations[r.dim]
                lead = min(LEAD, r.dim)
                q_rest, c_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1))
                q_norm, c_norm = np.sqrt((qf**2).sum(1)), np.sqrt((cf**2).sum(1))
                out = []
                for a in range(0, len(qi), 128):
                    rows = slice(a, a + 128)
                    low = floors[rows]
                    # Lengths descend: beyond this many rows not even the longest query of these reaches its floor.
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.where(q_norm[rows] > 0, low / q_norm[rows], np.where(low > 0, np.inf, -np.inf)).min(initial=np.inf)
                    far = int(np.searchsorted(-c_norm, -need * (1 - 1e-9) + 1e-6, "right")) if np.isfinite(need) else (0 if need > 0 else len(ci))
                    if not far:
                        continue
                    bound = qr[rows, :lead] @ cr[:far, :lead].T + q_rest[rows, None] * c_rest[None, :far]
                    live = (bound * (1 + 1e-9) + 1e-3 >= low[:, None]).any(0)
                    at = np.flatnonzero(live)
                    if not len(at):
                        continue
                    score = (qf[rows] @ cf[at].T).astype(np.int64) if exact else q[rows] @ c[at].T
                    ids, numbers = ci[at], c_row[at]
                    for x in range(score.shape[0]):
                        ok = np.flatnonzero((numbers != q_row[a + x]) & (score[x] >= low[x]))
                        if len(ok) > k:  # all that tie with the k-th stay until the ids decide
                            ok = ok[score[x][ok] >= np.partition(score[x][ok], len(ok) - k)[len(ok) - k]]
                        best = ok[np.lexsort((ids[ok], -score[x][ok]))][:k]
                        out.append(pd.DataFrame({"query": q_row[a + x], "query_id": qi[a + x], "vec_id": ids[best], "score": score[x][best]}))
                yield pd.concat(out) if out else pd.DataFrame({x.split()[0]: np.zeros(0, np.int64) for x in _HITS.split(", ")})

    return scan


def _packed(rows: DataFrame, per_block: int) -> DataFrame:
    """rows in blocks of about per_block by descending length: lengths are ranged by their quantiles, ties dealt by id."""
    cut = rows.withColumn("_level", F.floor(F.log2(F.col("norm") + 1) * 8)).withColumn("_bits", hash_bits(F.concat_ws(":", "vec_id", "row"), "topk:"))
    sizes = cut.groupBy(F.col("dim").alias("_d"), F.col("_level").alias("_l")).agg(F.ceil(F.count("*") / per_block).alias("_n"))
    sizes = keep(sizes.withColumn("_at", F.sum("_n").over(Window.orderBy("_d", F.desc("_l")))), "op5-levels")
    dealt = cut.join(F.broadcast(sizes), (F.col("dim") == F.col("_d")) & (F.col("_level") == F.col("_l")))
    dealt = dealt.withColumn("block", F.col("_at") - 1 - F.shiftright(F.col("_bits") * F.col("_n"), 48))
    return keep(dealt.select("vec_id", "row", "v", "dim", "norm", F.col("block").cast("long").alias("block")).groupBy("dim", "block").applyInPandas(_blocks, _BLOCK), "op5-blocks")


def top_k(rows: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """(vec_id, embedding), which rows are queries -> query_id, rank, vec_id, score."""
    numbered = rows.select("vec_id", "embedding", F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    every = keep(_integers(numbered).withColumn("norm", norm), "op5-vectors")
    gram = every.select("dim", "v").mapInPandas(_gram, "dim int, row int, col int, s double").groupBy("dim", "row", "col").agg(F.sum("s").alias("s")).toPandas()
    rotations: dict[int, np.ndarray] = {0: np.zeros((0, 0))}
    for dim, g in gram.groupby("dim"):
        m = np.zeros((dim, dim))
        m[g.row, g.col] = g.s
        rotations[int(dim)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    cand, query_blocks = _packed(every, BLOCK), _packed(every.where("asked"), QUERIES)
    qs = query_blocks.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"), F.col("data").alias("q_data"), F.col("wide").alias("q_wide"))
    tops = query_blocks.select("dim", F.col("block").alias("q_block"), F.col("top").alias("q_top"))

    def scanned(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        """Pairs of block numbers -> the best of each query in each block; the blocks are joined to the pairs by their numbers."""
        pairs = keep(pairs, "op5-pairs")
        met = pairs.join(qs, ["dim", "q_block"])
        met = met.join(floors.select("dim", "q_block", F.col("fl").alias("floors")), ["dim", "q_block"]) if floors is not None else met.withColumn("floors", F.lit(None).cast("array<double>"))
        return met.join(cand, ["dim", "block"]).repartition(max(8, pairs.count()), "q_block", "block").mapInPandas(_scan(rotations, k), _HITS)

    # The first pass: the blocks of the longest vectors, for the floors.
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = cand.select("dim", "block", before.alias("before")).where(F.col("before") < HEAD).drop("before")
    seen = scanned(tops.select("dim", "q_block").join(broadcast_up_to(head, BROADCAST), "dim"), None)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kth = keep(seen.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("s")), "op5-floors")
    order = query_blocks.select("dim", "block", "numbers").mapInPandas(_positions, "dim int, block long, pos int, query long")
    floors = order.join(kth, "query", "left").groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("f"))
    floors = floors.select("dim", F.col("block").alias("q_block"), F.transform("f", lambda x: F.coalesce(x["s"], F.lit(float("-inf")))).alias("fl")).withColumn("low", F.array_min("fl"))
    floors = keep(floors, "op5-floors")
    # Pairs of block numbers, a few bytes each, pruned before any block moves.
    pairs = tops.join(floors.drop("fl"), ["dim", "q_block"]).join(broadcast_up_to(cand.select("dim", "block", "top"), BROADCAST), "dim").where(F.col("q_top") * F.col("top") * (1 + 1e-9) + 1e-3 >= F.col("low"))
    hits = scanned(pairs.select("dim", "q_block", "block"), floors)
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _positions(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            numbers = np.frombuffer(r.numbers, np.int64)
            yield pd.DataFrame({"dim": r.dim, "block": r.block, "pos": np.arange(len(numbers), dtype=np.int32), "query": numbers})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
