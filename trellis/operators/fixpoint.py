"""Fixpoints over edge tables: closures, shortest distances. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.storage import written


#: So many edges are walked on the driver: they have at most some 500,000 pairs of ends. Beyond, rounds of joins; the result is the same.
SMALL = 1_000
#: Steps of a search in one round.
STEPS = 4


def _few(edges: DataFrame) -> list | None:
    found = edges.limit(SMALL + 1).collect()
    return found if len(found) <= SMALL else None


def _walk(next_of: dict, start) -> dict:
    """What is reached from the nodes of start, by one edge or more, and in how many."""
    found, front, k = {}, list(start), 0
    while front:
        k += 1
        front = list(dict.fromkeys(b for a in front for b in next_of.get(a, ()) if b not in found))
        found.update(dict.fromkeys(front, k))
    return found


def _next(pairs) -> dict:
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def closure(edges: DataFrame, keys: list[str] = (), start: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) with a path of one edge or more from a to b, within equal keys; from start or seeds (s) alone if given. Cycles end."""
    keys, spark = list(keys), edges.sparkSession
    edges = edges.select(*keys, "a", "b").distinct()
    if (few := _few(edges)) is not None:
        by: dict = {}
        for r in few:
            by.setdefault(tuple(r[:-2]), []).append(tuple(r[-2:]))
        rows = [(*k, a, b) for k, pairs in by.items() for n in [_next(pairs)] for a in (n if start is None else [start]) for b in _walk(n, [a])]
        out = spark.createDataFrame(rows, edges.schema)
        return out if seeds is None else out.join(seeds.select(F.col("s").alias("a")), "a", "left_semi").select(*keys, "a", "b")
    edges = written(edges, "edges")
    reached = edges if start is None else edges.where(F.col("a") == start)
    if seeds is not None:
        reached = edges.join(seeds.select(F.col("s").alias("a")), "a", "left_semi").select(*keys, "a", "b")
    reached = front = written(reached, "reached")
    step = edges.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
    while not front.isEmpty():
        front = written(front.join(step, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")).distinct().join(reached, [*keys, "a", "b"], "left_anti"), "front")
        reached = reached.unionByName(front)
    return reached


def distances(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(a, b), (node) -> (node, distance): the fewest edges from any start; rounds of one frontier join each."""
    edges = edges.select("a", "b").distinct()
    if (few := _few(edges)) is not None:
        first = start.select("node", F.lit(0).alias("distance")).distinct()
        ends = edges.sparkSession.createDataFrame([(x,) for x in {r[0] for r in few}], "node string") if few else None
        begin = [r[0] for r in start.join(F.broadcast(ends), "node", "left_semi").distinct().collect()] if few else []  # at most as many as edges
        rows = [(b, k) for b, k in _walk(_next(few), begin).items() if max_depth is None or k <= max_depth]
        found = edges.sparkSession.createDataFrame(rows, "node string, distance int")
        return first.unionByName(found.join(first, "node", "left_anti"))
    edges = written(edges, "edges")
    seen = front = written(start.select("node", F.lit(0).alias("distance")).distinct(), "front")
    depth = 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        steps = STEPS if max_depth is None else min(STEPS, max_depth - depth)
        found, at = None, front.select("node")
        for k in range(1, steps + 1):  # several steps a round: what a later one finds again is farther
            at = at.join(edges, at["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
            one = at.select("node", F.lit(depth + k).alias("distance"))
            found = one if found is None else found.unionByName(one)
        depth += steps
        new = written(found.groupBy("node").agg(F.min("distance").alias("distance")).join(seen, "node", "left_anti"), "front")
        seen, front = seen.unionByName(new), new.where(F.col("distance") == depth)
    return seen
