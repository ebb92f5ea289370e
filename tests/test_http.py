"""The HTTP store against a small server on this machine, and the migration of registries."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from trellis.dataset import GraphDataset
from trellis.migrate import main
from trellis.operators.store import Graph, SparkStore
from trellis.sources.http import HttpClient, HttpError, HttpStore


@pytest.fixture
def server(spark):
    state = {"store": SparkStore(spark), "datasets": {"d": "active"}, "fail": 0, "seen": []}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, status, text="", kind="text/plain"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(text.encode())

        def handle_any(self):
            url = urllib.parse.urlsplit(self.path)
            params = dict(urllib.parse.parse_qsl(url.query))
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            state["seen"].append((self.command, url.path, self.headers.get("X-Token")))
            if state["fail"]:
                state["fail"] -= 1
                return self.answer(503, "busy")
            store, parts = state["store"], url.path.strip("/").split("/")
            if parts[0] == "$":
                name = parts[2] if len(parts) > 2 else None
                if self.command == "POST" and name is None:
                    name = dict(urllib.parse.parse_qsl(body))["dbName"]
                    known = name in state["datasets"]
                    state["datasets"].setdefault(name, "active")
                    return self.answer(409 if known else 200)
                if name is None:
                    return self.answer(200, json.dumps({"datasets": [{"ds.name": "/" + x} for x in state["datasets"]]}))
                if name not in state["datasets"]:
                    return self.answer(404)
                if self.command == "DELETE":
                    del state["datasets"][name]
                elif self.command == "POST":
                    state["datasets"][name] = params["state"]
                return self.answer(200, json.dumps({"ds.name": "/" + name, "ds.state": state["datasets"].get(name)}))
            if parts[1] == "data":
                g = params["graph"]
                if self.command == "GET":
                    return self.answer(200, store.get_graph(g).serialize("nt")) if store.graph_exists(g) else self.answer(404)
                if self.command == "DELETE":
                    store.delete_graph(g)
                else:
                    (store.put_graph if self.command == "PUT" else store.post_graph)(g, Graph.parse(body, "nt"))
                return self.answer(204)
            sparql = dict(urllib.parse.parse_qsl(body)).get("query") or dict(urllib.parse.parse_qsl(body))["update"]
            if parts[1] == "update":
                store.update(sparql)
                return self.answer(204)
            if sparql.startswith("ASK"):
                return self.answer(200, json.dumps({"boolean": store.ask(sparql)}), "application/sparql-results+json")
            if sparql.startswith("CONSTRUCT"):
                return self.answer(200, store.construct(sparql).serialize("nt"), "application/n-triples")

            def term(t):
                if t.startswith("<"):
                    return {"type": "uri", "value": t[1:-1]}
                text, _, kind = t[1:].rpartition('"')
                return {"type": "literal", "value": text} | ({"datatype": kind[3:-1]} if kind.startswith("^^") else {"xml:lang": kind[1:]} if kind else {})

            rows = [{k: term(v) for k, v in r.asDict().items() if v is not None} for r in store.frame(sparql).collect()]
            self.answer(200, json.dumps({"results": {"bindings": rows}}), "application/sparql-results+json; charset=utf-8")

        do_GET = do_POST = do_PUT = do_DELETE = handle_any

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()
    http.server_close()


def test_store(server, spark):
    url, state = server
    store = HttpStore(url, "d", extra_headers={"X-Token": "t"})
    store.parse_into("urn:g", '@prefix x: <urn:x:> . x:a x:n 1 ; x:l "ä \\"q\\""@de ; x:to x:b .')
    store.post_graph("urn:h", [("<urn:x:b>", "<urn:x:n>", '"2"^^<http://www.w3.org/2001/XMLSchema#integer>')])
    assert store.list_named_graphs() == ["urn:g", "urn:h"] and store.graph_exists("urn:g") and not store.graph_exists("urn:none")
    assert store.get_graph("urn:g") == state["store"].get_graph("urn:g") and len(store.get_graph("urn:g")) == 3
    assert sorted(r["n"] for r in store.query("SELECT ?s ?n WHERE { GRAPH ?g { ?s <urn:x:n> ?n } }")) == [1, 2]
    assert store.query("SELECT ?n WHERE { GRAPH ?g { ?s <urn:x:n> ?n } }", s="urn:x:b") == [{"n": 2}]
    assert store.construct("CONSTRUCT { ?s <urn:x:m> ?n } WHERE { GRAPH ?g { ?s <urn:x:n> ?n } }") == state["store"].construct("CONSTRUCT { ?s <urn:x:m> ?n } WHERE { GRAPH ?g { ?s <urn:x:n> ?n } }")
    assert store.quads(spark).count() == 4 and store.quads(spark, ["urn:h"]).count() == 1 and store.quads(spark, []).count() == 0
    store.update('INSERT DATA { GRAPH <urn:h> { <urn:x:c> <urn:x:n> "3" } }')
    store.put_graph("urn:g", [("<urn:x:z>", "<urn:x:n>", '"0"')])
    assert len(store.get_graph("urn:h")) == 2 and len(store.get_graph("urn:g")) == 1
    store.delete_graph("urn:g")
    store.delete_graph("urn:g")
    with pytest.raises(HttpError) as e:
        store.get_graph("urn:g")
    assert e.value.status == 404 and {x[2] for x in state["seen"]} == {"t"}


def test_retries(server):
    url, state = server
    waits = []
    client = HttpClient(url, "d", sleep=waits.append)
    state["fail"] = 3
    assert client.dataset_exists() and waits == [0.5, 1.0, 2.0]
    state["fail"], state["seen"] = 9, []
    with pytest.raises(HttpError) as e:
        client.list_datasets()
    assert e.value.status == 503 and len(state["seen"]) == 4
    with pytest.raises(HttpError) as e:
        HttpClient("http://127.0.0.1:9", "d", max_retries=1, sleep=waits.append).list_datasets()
    assert e.value.status is None


def test_datasets(server):
    url, state = server
    client = HttpClient(url)
    assert [x["ds.name"] for x in client.list_datasets()] == ["/d"] and not client.dataset_exists("e")
    assert client.create_dataset("e", "mem")["dbType"] == "mem" and client.get_or_create_dataset("e")["ds.name"] == "/e"
    with pytest.raises(HttpError) as e:
        client.create_dataset("e")
    assert e.value.status == 409
    assert client.set_dataset_state("e", online=False) and client.get_dataset("e")["ds.state"] == "offline"
    assert client.delete_dataset("e") and not client.delete_dataset("e")
    with pytest.raises(HttpError):
        client.query_sparql("ASK { }")


def test_migration(server, spark, tmp_path, capsys):
    url, state = server
    ds = GraphDataset(spark, load_ontology=False, metadata_updates="off")
    reg = ds.registry
    ds.store.parse_into(reg, f"<urn:h> a <{ds.cga('Holon')[1:-1]}> ; <{ds.cga('hasInterior')[1:-1]}> <urn:h/in> .")
    folder = str(tmp_path / "quads")
    ds.store.save(folder)
    state["store"].put_graph(reg, ds.store.get_graph(reg))
    for where in (folder, f"{url}/d"):
        assert main([where], spark) == 0 and "missing" in capsys.readouterr().out
        assert main([where, "--apply"], spark) == 0 and "<urn:h/in>" in capsys.readouterr().out
        assert main([where], spark) == 0 and "nothing to do" in capsys.readouterr().out
    assert SparkStore.open(spark, folder).get_graph(reg) == state["store"].get_graph(reg)
    assert main(["http://x"], spark) == 2 and main(["gopher://x/y"], spark) == 2
