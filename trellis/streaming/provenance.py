"""Provenance of a stream: each micro-batch of quads is appended to a table and recorded as one activity."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.terms import PROV, TYPE, XSD, iri


def append_batches(stream: DataFrame, path: str, context: str, agent: str, checkpoint: str):
    """A stream of quads (g, s, p, o) -> a query that appends to the Parquet table at path. Batches carry their number, so a batch that is
    written again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        a, at = iri(f"urn:prov:batch:{number}"), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        about = [(iri(context), a, TYPE, f"<{PROV}Activity>"), (iri(context), a, f"<{PROV}wasAssociatedWith>", iri(agent)), (iri(context), a, f"<{PROV}endedAtTime>", f'"{at}"^^<{XSD}dateTime>')]
        rows = batch.select("g", "s", "p", "o").unionByName(batch.sparkSession.createDataFrame(about, "g string, s string, p string, o string"))
        rows.dropDuplicates().withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
