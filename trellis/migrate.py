"""Types a registry's layer graphs: python -m trellis.migrate STORE [--apply] [--registry-graph IRI] [--vocabulary IRI].

STORE is a folder of quads as SparkStore.save writes them, or a server's http://host:port/dataset. Without --apply the missing triples
are printed and nothing is written. A second run finds nothing to do. Exit codes: 0, or 2 if STORE is neither or names no dataset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from trellis.dataset import REGISTRY, VOCABULARY, GraphDataset
from trellis.functions.terms import iri
from trellis.operators.store import SCHEMA, SparkStore
from trellis.sources.http import HttpStore


def _server(url: str) -> HttpStore:
    base, _, dataset = url.rstrip("/").rpartition("/")
    if not dataset or base.endswith("/") or "://" not in base:
        raise ValueError(f"{url}: no dataset in http://host:port/dataset")
    return HttpStore(base, dataset)


def migrate(spark: SparkSession, store: str, apply: bool = False, registry: str = REGISTRY, vocabulary: str = VOCABULARY) -> list[tuple]:
    """The triples that the registry lacks; with apply they are added to it."""
    if store.startswith(("http://", "https://")):
        server = _server(store)
        here = SparkStore(spark)
        here.put_graph(registry, server.get_graph(registry) if server.graph_exists(registry) else ())
    elif "://" in store.removeprefix("file://").removeprefix("hdfs://").removeprefix("s3a://"):
        raise ValueError(f"{store}: unknown kind of store")
    else:
        server, here = None, SparkStore.open(spark, store)
    plan = GraphDataset(here, registry, load_ontology=False, metadata_updates="off", vocabulary=vocabulary).untyped_layers()
    if apply and plan:
        if server:
            server.post_graph(registry, plan)
        else:
            spark.createDataFrame([(iri(registry), *t) for t in plan], SCHEMA).write.mode("append").parquet(store)
    return plan


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="python -m trellis.migrate", description="Types a registry's layer graphs.")
    args.add_argument("store")
    args.add_argument("--apply", action="store_true")
    args.add_argument("--registry-graph", default=REGISTRY)
    args.add_argument("--vocabulary", default=VOCABULARY)
    got = args.parse_args(argv)
    try:
        plan = migrate(spark or SparkSession.builder.getOrCreate(), got.store, got.apply, got.registry_graph, got.vocabulary)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for triple in plan:
        print("+", *triple)
    print(f"{len(plan)} triples {'added' if got.apply else 'missing; --apply adds them'}" if plan else "nothing to do")
    return 0


if __name__ == "__main__":
    sys.exit(main())
