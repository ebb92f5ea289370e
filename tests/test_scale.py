"""Plans that must hold at size: no join of all rows with all rows, no task that holds what should be shared."""

import itertools

import pytest

from trellis.operators import store as stores
from trellis.plans.compile import Compiler, Solution
from trellis.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("minus", [True, False])
def test_anti_join_of_unbound_variables_compares_keys(spark, minus):
    values = [None, '"1"', '"2"']
    left = [(f'"{k}"', x, y) for k, (x, y) in enumerate(itertools.product(values, values))]
    for right in ([('"1"', None)], [(None, '"2"')], [('"1"', '"2"')], [(None, None)], [('"1"', None), (None, '"1"')], list(itertools.product(values[1:], values))):
        a = Solution(spark.createDataFrame(left, "k string, x string, y string"), {"k"}, {"x", "y"})
        b = Solution(spark.createDataFrame(right, "x string, y string"), set(), {"x", "y"})
        meets = lambda p, q: all(None in (u, v) or u == v for u, v in zip(p, q)) and (not minus or any(u is not None and u == v for u, v in zip(p, q)))
        got = Compiler(spark, a.df).join(a, b, "left_anti", minus=minus).df
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in a.df.collect() if not any(meets(r[1:], q) for q in right))


def test_minus_of_an_unbound_variable_has_no_nested_loop(spark):
    found = plan(QUERIES["minus_unbound"](spark, DIR))
    assert "NestedLoop" not in found and "Cartesian" not in found


def early(df) -> list[str]:
    """The distinct steps over triples that hold a task's rows before any exchange."""
    steps = [x.lstrip(" :+-*").partition(")")[2].lstrip() if x.lstrip(" :+-*").startswith("(") else x.lstrip(" :+-*") for x in plan(df).splitlines()]
    return [x for x, below in zip(steps, steps[1:]) if x.startswith("HashAggregate") and "o#" in x and x.endswith("functions=[])") and not below.startswith(("HashAggregate", "Exchange"))]


@pytest.mark.parametrize("name", ["count_triples_by_graph", "rdfs_types", "localize_predicates", "describe", "compose_union"])
def test_triples_are_dealt_before_repeats_are_sought(spark, name):
    assert not early(QUERIES[name](spark, DIR))


def test_bulk_update_shuffles_only_what_its_templates_name(spark, monkeypatch):
    monkeypatch.setattr(stores, "FEW", 3)
    seen = []
    monkeypatch.setattr(stores, "written", lambda df, label, own=stores.written: seen.append((label, plan(df))) or own(df, label))
    want = {(f"<urn:{g}>", f"<urn:s{k}>", f"<urn:{p}>", f'"{k % 3}"') for g in "ab" for p in "pq" for k in range(9)}
    store = stores.SparkStore(spark, spark.createDataFrame([*want, *want], stores.SCHEMA))  # every quad twice
    store.update('DELETE { GRAPH <urn:a> { ?s <urn:p> "1" } } INSERT { GRAPH <urn:a> { ?s <urn:p> "2" . ?s <urn:new> [] } } WHERE { GRAPH <urn:a> { ?s <urn:p> "1" } }')
    hit = {q for q in want if (q[0], q[2], q[3]) == ("<urn:a>", "<urn:p>", '"1"')}
    got = {tuple(r) for r in store.quads.collect()}
    assert {q for q in got if q[2] != "<urn:new>"} == want - hit | {(*q[:3], '"2"') for q in hit} and len(got) == len(want) + len(hit) == store.quads.count()
    lines = next(p for label, p in reversed(seen) if label == "quads").splitlines()
    at = next(k for k, x in enumerate(lines) if "Union" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    end = next(k for k in range(at + 2, len(lines)) if depth(lines[k]) <= depth(lines[at + 1]))
    assert not any("Exchange" in x for x in lines[at + 1 : end])
    store.update('COPY <urn:a> TO <urn:c> ; DELETE { ?s <urn:q> "0" } WHERE { GRAPH <urn:c> { ?s <urn:q> "0" } }')  # in any graph
    left = {q for q in got if q[2:] != ("<urn:q>", '"0"')}
    assert {tuple(r) for r in store.quads.collect()} == left | {("<urn:c>", *q[1:]) for q in left if q[0] == "<urn:a>"}
