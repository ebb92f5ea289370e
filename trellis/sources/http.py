"""A store behind a SPARQL 1.1 server: queries and updates by the SPARQL Protocol, graphs by the Graph Store Protocol, datasets by the
administration paths that servers offer under /$/datasets.

HttpStore keeps the interface of a store, so a GraphDataset's small graphs may live on a server; `quads` brings them into Spark."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from trellis.functions.terms import decode, iri, literal
from trellis.operators.store import SCHEMA, AbstractGraphStore, Graph, Triple

# Media types of the formats.
MEDIA = {"turtle": "text/turtle", "nt": "application/n-triples", "xml": "application/rdf+xml", "json-ld": "application/ld+json"}
RESULTS = "application/sparql-results+json"


class HttpError(RuntimeError):
    """What a server answers beyond the expected; status is None if it did not answer."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class HttpClient:
    """Requests to one server. Answers of 500 and above, time-outs and refused connections are tried again, each time after twice the wait.

    A POST that the server has carried out without answering is sent again; twice differs from once only for blank nodes that it adds."""

    def __init__(self, base_url: str, dataset: str | None = None, *, max_retries: int = 3, retry_backoff: float = 0.5, timeout: float = 60.0, extra_headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.base_url, self.dataset = base_url.rstrip("/"), dataset
        self.max_retries, self.retry_backoff, self.timeout = max_retries, retry_backoff, timeout
        self.extra_headers, self._sleep = dict(extra_headers or {}), sleep

    def url(self, *parts: str, **params: str) -> str:
        path = "/".join(urllib.parse.quote(p, safe="$") for p in parts)
        return f"{self.base_url}/{path}" + (f"?{urllib.parse.urlencode(params)}" if params else "")

    def request(self, method: str, url: str, expected: Iterable[int], data: bytes | None = None, headers: dict[str, str] | None = None) -> tuple[int, str, str]:
        """(status, media type, text) of the answer; HttpError if the status is not expected."""
        wanted = set(expected)
        for attempt in range(self.max_retries + 1):
            status, kind, text = self._once(method, url, data, headers or {})
            if status in wanted:
                return status, kind, text
            if status is not None and status < 500:
                break
            if attempt < self.max_retries:
                self._sleep(self.retry_backoff * 2**attempt)
        raise HttpError(f"{method} {url}: {status or 'no answer'} {text[:500]}", status)

    def _once(self, method: str, url: str, data: bytes | None, headers: dict[str, str]) -> tuple[int | None, str, str]:
        request = urllib.request.Request(url, data, {**self.extra_headers, **headers}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.headers.get("Content-Type", ""), answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return e.code, "", e.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            return None, "", str(e)

    def form(self, url: str, fields: dict[str, str], expected: Iterable[int], accept: str = "*/*") -> tuple[int, str, str]:
        headers = {"Content-Type": "application/x-www-form-urlencoded", "Accept": accept}
        return self.request("POST", url, expected, urllib.parse.urlencode(fields).encode(), headers)

    def _named(self, dataset: str | None) -> str:
        name = dataset or self.dataset
        if not name:
            raise HttpError("no dataset named")
        return name

    # SPARQL
    def query_sparql(self, sparql: str, accept: str = RESULTS) -> dict:
        """The parsed answer of SELECT and ASK; else its text as raw."""
        _, kind, text = self.form(self.url(self._named(None), "sparql"), {"query": sparql}, (200,), accept)
        return json.loads(text) if RESULTS in kind else {"raw": text, "content_type": kind}

    def update_sparql(self, sparql: str) -> int:
        return self.form(self.url(self._named(None), "update"), {"update": sparql}, (200, 204))[0]

    # graphs
    def _graph(self, graph: str) -> str:
        return self.url(self._named(None), "data", graph=graph)

    def read_graph(self, graph: str, format: str = "nt") -> Graph:
        """The triples of a graph; HttpError 404 if there is none."""
        return Graph.parse(self.request("GET", self._graph(graph), (200,), headers={"Accept": MEDIA[format]})[2], format)

    def write_graph(self, method: str, graph: str, triples: Iterable[Triple]) -> int:
        return self.request(method, self._graph(graph), (200, 201, 204), Graph(triples).serialize("nt").encode(), {"Content-Type": MEDIA["nt"]})[0]

    def drop_graph(self, graph: str) -> int:
        return self.request("DELETE", self._graph(graph), (200, 204, 404))[0]

    # datasets
    def _datasets(self, *name: str, **params: str) -> str:
        return self.url("$", "datasets", *name, **params)

    def list_datasets(self) -> list[dict]:
        return json.loads(self.request("GET", self._datasets(), (200,))[2]).get("datasets", [])

    def get_dataset(self, dataset: str | None = None) -> dict:
        return json.loads(self.request("GET", self._datasets(self._named(dataset)), (200,))[2])

    def dataset_exists(self, dataset: str | None = None) -> bool:
        return self.request("GET", self._datasets(self._named(dataset)), (200, 404))[0] == 200

    def create_dataset(self, dataset: str | None = None, db_type: str = "tdb2") -> dict:
        name = self._named(dataset)
        status, _, text = self.form(self._datasets(), {"dbName": name, "dbType": db_type}, (200, 201))
        return json.loads(text) if text.lstrip().startswith("{") else {"status": status, "dataset": name, "dbType": db_type}

    def get_or_create_dataset(self, dataset: str | None = None, db_type: str = "tdb2") -> dict:
        """Also right if another client creates it in between."""
        if not self.dataset_exists(dataset):
            try:
                return self.create_dataset(dataset, db_type)
            except HttpError as e:
                if e.status != 409:
                    raise
        return self.get_dataset(dataset)

    def delete_dataset(self, dataset: str | None = None) -> bool:
        """Whether there was one."""
        return self.request("DELETE", self._datasets(self._named(dataset)), (200, 204, 404))[0] != 404

    def set_dataset_state(self, dataset: str | None = None, online: bool = True) -> bool:
        self.request("POST", self._datasets(self._named(dataset), state="active" if online else "offline"), (200,), b"")
        return True


def token(term: dict[str, str]) -> str:
    """A term of a JSON result as a token."""
    if term["type"] == "uri":
        return iri(term["value"])
    if term["type"] == "bnode":
        return "_:" + term["value"]
    return literal(term["value"], term.get("datatype"), term.get("xml:lang"))


class HttpStore(AbstractGraphStore):
    """The store's interface over a client. Bindings are put before the query's pattern as VALUES."""

    def __init__(self, base_url: str, dataset: str | None = None, **options):
        self.client = HttpClient(base_url, dataset, **options)

    def graph_exists(self, graph: str) -> bool:
        return self.ask(f"ASK {{ GRAPH {iri(graph)} {{ ?s ?p ?o }} }}")

    def get_graph(self, graph: str) -> Graph:
        return self.client.read_graph(graph)

    def put_graph(self, graph: str, triples: Iterable[Triple]) -> None:
        self.client.write_graph("PUT", graph, triples)

    replace_graph_atomically = put_graph

    def post_graph(self, graph: str, triples: Iterable[Triple]) -> None:
        self.client.write_graph("POST", graph, triples)

    def delete_graph(self, graph: str) -> None:
        self.client.drop_graph(graph)

    def parse_into(self, graph: str, data: str, format: str = "turtle") -> None:
        self.post_graph(graph, Graph.parse(data, format))

    def list_named_graphs(self) -> list[str]:
        return sorted(r["g"] for r in self.query("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }"))

    def _bound(self, sparql: str, bindings: dict[str, Any]) -> str:
        if not bindings:
            return sparql
        values = [v if isinstance(v, str) and v.startswith(("<", '"')) else iri(v) if isinstance(v, str) and v.startswith("urn:") else literal(v) for v in bindings.values()]
        return f"{sparql} VALUES ({' '.join('?' + k for k in bindings)}) {{ ({' '.join(values)}) }}"

    def rows(self, sparql: str, **bindings) -> list[dict[str, str]]:
        """The solutions of a SELECT as tokens."""
        found = self.client.query_sparql(self._bound(sparql, bindings))
        return [{k: token(v) for k, v in row.items()} for row in found["results"]["bindings"]]

    def query(self, sparql: str, **bindings) -> list[dict[str, Any]]:
        return [{k: decode(v) for k, v in row.items()} for row in self.rows(sparql, **bindings)]

    def construct(self, sparql: str, **bindings) -> Graph:
        return Graph.parse(self.client.query_sparql(self._bound(sparql, bindings), MEDIA["nt"])["raw"], "nt")

    def ask(self, sparql: str, **bindings) -> bool:
        return bool(self.client.query_sparql(self._bound(sparql, bindings)).get("boolean", False))

    def update(self, sparql: str) -> None:
        self.client.update_sparql(sparql)

    def quads(self, spark: SparkSession, graphs: list[str] | None = None) -> DataFrame:
        """The server's graphs, or those named, as quads: a request a graph, each made by the task that reads it, which Spark repeats if it is lost."""
        names = self.list_named_graphs() if graphs is None else list(graphs)
        client = self.client

        def read(batches):
            import pandas as pd

            for batch in batches:
                for g in batch.g:
                    yield pd.DataFrame([(iri(g), *t) for t in sorted(client.read_graph(g))], columns=["g", "s", "p", "o"])

        named = spark.createDataFrame([(g,) for g in names], "g string")
        return named.repartition(max(1, min(len(names), 200))).mapInPandas(read, SCHEMA)
