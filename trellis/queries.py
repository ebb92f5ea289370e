"""The registered queries of the graph engine over the driver's tables, lifted to quads, and the same in SQL.

Regions, nations, customers and suppliers form a containment forest; each nation's graph holds its customers; orders, line items and parts
have one graph a table; events are provenance activities. Portals between nations follow (3 * n + 1) modulo 25."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import PROV, RDF, RDFS, SH, TYPE
from trellis.operators import projection, rdfs, shacl
from trellis.operators.distinct import once
from trellis.operators.fixpoint import distances
from trellis.plans.compile import Compiler
from trellis.plans.sparql import parse
from trellis.sources.lift import lift, ref
from trellis.sources.turtle import parse as turtle

P = "urn:t:"
REG = "urn:holarchy:registry"
_PREFIX = f"PREFIX : <{P}> PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> PREFIX prov: <{PROV}> "


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def customers(spark, d):
    return lift(_table(spark, d, "customer"), ref(f"{P}nation:", "c_nationkey"), ref(f"{P}customer:", "c_custkey"), {f"{P}name": "c_name", f"{P}mktsegment": "c_mktsegment", f"{P}acctbal": "c_acctbal", f"{P}nation": ref(f"{P}nation:", "c_nationkey")}, f"{P}Customer")


def suppliers(spark, d):
    return lift(_table(spark, d, "supplier"), f"{P}suppliers", ref(f"{P}supplier:", "s_suppkey"), {f"{P}name": "s_name", f"{P}acctbal": "s_acctbal", f"{P}nation": ref(f"{P}nation:", "s_nationkey")}, f"{P}Supplier")


def orders(spark, d):
    return lift(_table(spark, d, "orders"), f"{P}orders", ref(f"{P}order:", "o_orderkey"), {f"{P}customer": ref(f"{P}customer:", "o_custkey"), f"{P}total": "o_totalprice", f"{P}status": "o_orderstatus", f"{P}priority": "o_orderpriority", f"{P}date": "o_orderdate"}, f"{P}Order")


def parts(spark, d):
    return lift(_table(spark, d, "part"), f"{P}parts", ref(f"{P}part:", "p_partkey"), {f"{RDFS}label": "p_name", f"{P}brand": "p_brand", f"{P}type": "p_type", f"{P}size": "p_size", f"{P}price": "p_retailprice"}, f"{P}Part")


def registry(spark, d):
    """Regions and nations as units, nations in regions, layers of nations, portals between them."""
    region = lift(_table(spark, d, "region"), REG, ref(f"{P}region:", "r_regionkey"), {f"{RDFS}label": "r_name"}, f"{P}Holon")
    n = _table(spark, d, "nation")
    nation = lift(n, REG, ref(f"{P}nation:", "n_nationkey"), {f"{RDFS}label": "n_name", f"{P}memberOf": ref(f"{P}region:", "n_regionkey"), f"{P}hasInterior": ref(f"{P}nation:", "n_nationkey")}, f"{P}Holon")
    to = n.withColumn("to", (F.col("n_nationkey") * 3 + 1) % 25)
    portal = lift(to, REG, ref(f"{P}portal:", "n_nationkey"), {f"{P}sourceHolon": ref(f"{P}nation:", "n_nationkey"), f"{P}targetHolon": ref(f"{P}nation:", "to")}, f"{P}Portal")
    return region.unionByName(nation).unionByName(portal)


def events(spark, d):
    e = _table(spark, d, "events")
    return lift(e, f"{P}context", ref(f"{P}event:", "event_id"), {f"{PROV}wasAssociatedWith": ref(f"{P}user:", "user_id"), f"{PROV}startedAtTime": "ts", f"{P}kind": "event_type", f"{P}value": "value"}, f"{PROV}Activity")


def key(column: str) -> Column:
    """The number at the end of an IRI."""
    return F.regexp_extract(column, r"(\d+)>$", 1).try_cast("long")


TYPES: dict[str, Callable[[str], Column]] = {"key": key, "str": lambda c: T.lexical(F.col(c)), "num": lambda c: T.number(F.col(c)), "int": lambda c: T.number(F.col(c)).cast("long"), "bool": lambda c: T.boolean(F.col(c)), "round": lambda c: F.round(T.number(F.col(c)), 2)}


def _sparql(text: str, lifts: tuple, **types: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        quads = lifts[0](spark, d)
        for f in lifts[1:]:
            quads = quads.unionByName(f(spark, d))
        out = Compiler(spark, quads).run(parse(_PREFIX + text))
        return out.select(*[TYPES[kind](name).alias(name) for name, kind in types.items()])

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


_add("group_star_across_graphs", _sparql("SELECT ?segment (COUNT(?c) AS ?n) WHERE { GRAPH ?g { ?c a :Customer ; :mktsegment ?segment ; :nation ?nat . } GRAPH <urn:holarchy:registry> { ?nat :memberOf ?r . } } GROUP BY ?segment", (customers, registry), segment="str", n="int"),
     "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("bgp_star", _sparql("SELECT ?c ?name ?bal WHERE { GRAPH ?g { ?c a :Customer ; :name ?name ; :acctbal ?bal ; :mktsegment \"BUILDING\" } }", (customers,), c="key", name="str", bal="num"),
     "SELECT c_custkey AS c, c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("bgp_cross_graph", _sparql("SELECT ?o ?name WHERE { GRAPH :orders { ?o :customer ?c ; :status \"F\" } GRAPH ?g { ?c :name ?name } }", (customers, orders), o="key", name="str"),
     "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
_add("optional_left", _sparql("SELECT ?c ?o WHERE { GRAPH ?g { ?c a :Customer } OPTIONAL { GRAPH :orders { ?o :customer ?c } } }", (customers, orders), c="key", o="key"),
     "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_add("optional_filter_on", _sparql("SELECT ?c ?o WHERE { GRAPH ?g { ?c a :Customer } OPTIONAL { GRAPH :orders { ?o :customer ?c ; :total ?t } FILTER(?t > 200000) } }", (customers, orders), c="key", o="key"),
     "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
_add("union_bag", _sparql("SELECT ?x ?name WHERE { { GRAPH :suppliers { ?x :name ?name } } UNION { GRAPH ?g { ?x a :Customer ; :name ?name } } }", (customers, suppliers), x="key", name="str"),
     "SELECT s_suppkey AS x, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
_add("exists_semi", _sparql("SELECT ?c WHERE { GRAPH ?g { ?c a :Customer } FILTER EXISTS { GRAPH :orders { ?o :customer ?c ; :status \"O\" } } }", (customers, orders), c="key"),
     "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
_add("not_exists_anti", _sparql("SELECT ?c WHERE { GRAPH ?g { ?c a :Customer } FILTER NOT EXISTS { GRAPH :orders { ?o :customer ?c ; :status \"P\" } } }", (customers, orders), c="key"),
     "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_add("minus", _sparql("SELECT ?p WHERE { GRAPH :parts { ?p a :Part } MINUS { GRAPH :parts { ?p :brand \"Brand#11\" } } }", (parts,), p="key"),
     "SELECT p_partkey AS p FROM part WHERE p_brand <> 'Brand#11'")
_add("values_inline", _sparql("SELECT ?c ?s WHERE { VALUES ?s { \"BUILDING\" \"MACHINERY\" } GRAPH ?g { ?c :mktsegment ?s } }", (customers,), c="key", s="str"),
     "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("bind_if", _sparql("SELECT ?c ?k WHERE { GRAPH ?g { ?c :acctbal ?b } BIND(IF(?b < 0, \"debt\", IF(?b > 5000, \"rich\", \"plain\")) AS ?k) }", (customers,), c="key", k="str"),
     "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS k FROM customer")
_add("filter_functions", _sparql("SELECT ?p ?u ?l WHERE { GRAPH :parts { ?p :brand ?b ; :size ?z } FILTER(CONTAINS(?b, \"1\") && STRSTARTS(?b, \"Brand\") && ?z >= 10 && !(?z IN (20, 30))) BIND(CONCAT(UCASE(STR(?b)), \"/\", STR(?z)) AS ?u) BIND(STRLEN(?b) AS ?l) }", (parts,), p="key", u="str", l="int"),
     "SELECT p_partkey AS p, upper(p_brand) || '/' || p_size AS u, length(p_brand) AS l FROM part WHERE contains(p_brand, '1') AND p_size >= 10 AND p_size NOT IN (20, 30)")
_add("group_count_distinct", _sparql("SELECT ?b (COUNT(DISTINCT ?t) AS ?kinds) (COUNT(*) AS ?n) (MIN(?z) AS ?low) (MAX(?z) AS ?high) WHERE { GRAPH :parts { ?p :brand ?b ; :type ?t ; :size ?z } } GROUP BY ?b", (parts,), b="str", kinds="int", n="int", low="int", high="int"),
     "SELECT p_brand AS b, count(DISTINCT p_type) AS kinds, count(*) AS n, min(p_size)::BIGINT AS low, max(p_size)::BIGINT AS high FROM part GROUP BY 1")
_add("having", _sparql("SELECT ?c (COUNT(?o) AS ?n) WHERE { GRAPH :orders { ?o :customer ?c } } GROUP BY ?c HAVING (COUNT(?o) > 12)", (orders,), c="key", n="int"),
     "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_add("sum_avg", _sparql("SELECT ?p (SUM(?t) AS ?total) (AVG(?t) AS ?mean) WHERE { GRAPH :orders { ?o :priority ?p ; :total ?t } } GROUP BY ?p", (orders,), p="str", total="round", mean="round"),
     "SELECT o_orderpriority AS p, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
_add("order_limit_offset", _sparql("SELECT ?o ?t WHERE { GRAPH :orders { ?o :total ?t } } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", (orders,), o="key", t="num"),
     "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, 'urn:t:order:' || o_orderkey LIMIT 20 OFFSET 5")
_add("sub_select", _sparql("SELECT ?c ?name ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { GRAPH :orders { ?o :customer ?c } } GROUP BY ?c } GRAPH ?g { ?c :name ?name } FILTER(?n >= 10) }", (customers, orders), c="key", name="str", n="int"),
     "SELECT c_custkey AS c, c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE n >= 10")
_add("distinct_default_graph", _sparql("SELECT DISTINCT ?s WHERE { ?c :mktsegment ?s }", (customers,), s="str"), "SELECT DISTINCT c_mktsegment AS s FROM customer")
_add("theta_contains", _sparql("SELECT ?r ?n WHERE { GRAPH <urn:holarchy:registry> { ?a rdfs:label ?r . FILTER NOT EXISTS { ?a :memberOf ?x } ?b :memberOf ?y ; rdfs:label ?n } FILTER(CONTAINS(?r, SUBSTR(?n, 2, 1))) }", (registry,), r="str", n="str"),
     "SELECT r_name AS r, n_name AS n FROM region, nation WHERE contains(r_name, substr(n_name, 2, 1))")
_add("construct_triples", lambda spark, d: Compiler(spark, orders(spark, d)).run(parse(_PREFIX + "CONSTRUCT { ?c :placed ?o . ?o :worth ?t } WHERE { GRAPH :orders { ?o :customer ?c ; :total ?t } FILTER(?t > 300000) }")).groupBy(F.regexp_extract("p", r"([a-z]+)>$", 1).alias("p")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects")),
     "SELECT 'placed' AS p, count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders WHERE o_totalprice > 300000 HAVING count(*) > 0 UNION ALL SELECT 'worth', count(*), count(*) FROM orders WHERE o_totalprice > 300000 HAVING count(*) > 0")
_add("ask", lambda spark, d: Compiler(spark, customers(spark, d)).run(parse(_PREFIX + "ASK { GRAPH ?g { ?c :acctbal ?b } FILTER(?b < 0) }")),
     "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal < 0")
_add("update_modify", lambda spark, d: _modified(spark, d),
     "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status FROM orders) GROUP BY 1")
_add("path_member_of_plus", _sparql("SELECT ?x ?up WHERE { ?x (:nation|:memberOf)+ ?up }", (customers, registry), x="key", up="str"),
     "SELECT c_custkey AS x, 'urn:t:nation:' || c_nationkey AS up FROM customer UNION ALL SELECT c_custkey, 'urn:t:region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'urn:t:region:' || n_regionkey FROM nation")
_add("path_inverse_sequence", _sparql("SELECT ?s (COUNT(?c) AS ?n) WHERE { ?s ^:nation/:mktsegment ?c } GROUP BY ?s", (customers,), s="key", n="int"),
     "SELECT c_nationkey::BIGINT AS s, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1")
_add("count_triples_by_graph", lambda spark, d: once(customers(spark, d)).groupBy(key("g").alias("g")).agg(F.count("*").alias("triples"), F.sum((F.col("p") == TYPE).cast("long")).alias("typed")),
     "SELECT c_nationkey::BIGINT AS g, 5 * count(*) AS triples, count(*) AS typed FROM customer GROUP BY 1")


def _modified(spark, d):
    quads = orders(spark, d)
    compiler = Compiler(spark, quads)
    u = parse(_PREFIX + "DELETE { GRAPH :orders { ?o :status \"P\" } } INSERT { GRAPH :orders { ?o :status \"pending\" } } WHERE { GRAPH :orders { ?o :status \"P\" } }")[0]
    match = compiler.group(u.where)
    after = once(quads.join(compiler.construct(u.delete, match), ["g", "s", "p", "o"], "left_anti").unionByName(compiler.construct(u.insert, match)))
    return after.where(F.col("p") == f"<{P}status>").groupBy(T.lexical(F.col("o")).alias("status")).agg(F.count("*").alias("n"))


# the catalog
_add("holons_with_layers", _sparql("SELECT ?h ?label (COUNT(?i) AS ?interiors) WHERE { GRAPH <urn:holarchy:registry> { ?h a :Holon ; rdfs:label ?label . OPTIONAL { ?h :hasInterior ?i } } } GROUP BY ?h ?label", (registry,), h="str", label="str", interiors="int"),
     "SELECT 'urn:t:region:' || r_regionkey AS h, r_name AS label, 0::BIGINT AS interiors FROM region UNION ALL SELECT 'urn:t:nation:' || n_nationkey, n_name, 1 FROM nation")
_add("interior_classes", _sparql("SELECT ?h ?class (COUNT(DISTINCT ?x) AS ?n) WHERE { GRAPH <urn:holarchy:registry> { ?h :hasInterior ?g } GRAPH ?g { ?x a ?class } } GROUP BY ?h ?class", (registry, customers), h="key", **{"class": "str"}, n="int"),
     "SELECT c_nationkey::BIGINT AS h, 'urn:t:Customer' AS class, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("portals_from", _sparql("SELECT ?p ?t WHERE { GRAPH <urn:holarchy:registry> { ?p a :Portal ; :sourceHolon <urn:t:nation:7> ; :targetHolon ?t } }", (registry,), p="key", t="key"), "SELECT 7::BIGINT AS p, 22::BIGINT AS t FROM nation WHERE n_nationkey = 7")


def holarchy_depth(spark, d):
    quads = registry(spark, d)
    up = quads.where(F.col("p") == f"<{P}memberOf>").select(F.col("o").alias("a"), F.col("s").alias("b"))
    holons = quads.where((F.col("p") == TYPE) & (F.col("o") == f"<{P}Holon>")).select(F.col("s").alias("node"))
    roots = holons.join(up.select(F.col("b").alias("node")), "node", "left_anti")
    return distances(up, roots).select(T.lexical(F.col("node")).alias("holon"), F.col("distance").cast("long").alias("depth"))


_add("holarchy_depth", holarchy_depth, "SELECT 'urn:t:region:' || r_regionkey AS holon, 0::BIGINT AS depth FROM region UNION ALL SELECT 'urn:t:nation:' || n_nationkey, 1 FROM nation")


def _portal_edges(spark, d, both: bool = False):
    quads = registry(spark, d)
    e = Compiler(spark, quads).run(parse(_PREFIX + "SELECT ?a ?b WHERE { ?p :sourceHolon ?a ; :targetHolon ?b }"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e


def bfs_distance(spark, d, both: bool = False, depth: int | None = None):
    start = spark.createDataFrame([(f"<{P}nation:0>",)], "node string")
    return distances(_portal_edges(spark, d, both), start, depth).select(key("node").alias("nation"), F.col("distance").cast("long").alias("distance"))


_BFS = "WITH RECURSIVE e AS ({edges}), r(n, k) AS (SELECT 0, 0 UNION SELECT e.b, r.k + 1 FROM r JOIN e ON e.a = r.n WHERE r.k < {depth}) SELECT n::BIGINT AS nation, min(k)::BIGINT AS distance FROM r GROUP BY 1"
_ONE = "SELECT n_nationkey AS a, (3 * n_nationkey + 1) % 25 AS b FROM nation"
_add("bfs_distance", bfs_distance, _BFS.format(edges=_ONE, depth=26))
_add("neighborhood", partial(bfs_distance, both=True, depth=2), _BFS.format(edges=f"{_ONE} UNION SELECT b, a FROM ({_ONE})", depth=2))


def scope_resolve(spark, d):
    """Nations within three portals, in either direction, that have a customer of the segment BUILDING in debt."""
    near = bfs_distance(spark, d, True, 3)
    has = Compiler(spark, customers(spark, d)).run(parse(_PREFIX + "SELECT DISTINCT ?g WHERE { GRAPH ?g { ?c :mktsegment \"BUILDING\" ; :acctbal ?b FILTER(?b < 0) } }"))
    return near.join(has.select(key("g").alias("nation")), "nation", "left_semi")


_add("scope_resolve", scope_resolve, f"SELECT * FROM ({_BFS.format(edges=f'{_ONE} UNION SELECT b, a FROM ({_ONE})', depth=3)}) WHERE nation IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)")


def lineage(spark, d):
    """Orders that an order of the same customer follows, as derivations; how far each is from the customers' last order."""
    o = _table(spark, d, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    follow = o.select(F.col("o_orderkey"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))
    quads = lift(follow, f"{P}context", ref(f"{P}order:", "o_orderkey"), {f"{PROV}wasDerivedFrom": ref(f"{P}order:", "before")})
    edges = quads.select(F.col("s").alias("a"), F.col("o").alias("b"))
    last = follow.where("after is null").select(ref(f"{P}order:", "o_orderkey").alias("node"))
    return distances(edges, last).groupBy(F.col("distance").cast("long").alias("distance")).agg(F.count("*").alias("n"))


_add("lineage", lineage, "SELECT k::BIGINT AS distance, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS k FROM orders) GROUP BY 1")

# validation
_SHAPE = f"@prefix : <{P}> . @prefix sh: <{SH}> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "


def _shacl(text: str, source, value: bool = False):
    def run(spark, d):
        quads = source(spark, d)
        report = shacl.validate(quads.select("s", "p", "o"), [q[1:] for q in turtle(_SHAPE + text)], quads)
        return report.select(key("focus").alias("focus"), F.regexp_extract("severity", "#(.*)$", 1).alias("severity"), *([T.lexical(F.col("value")).alias("value")] if value else []))

    return run


def _with_gaps(spark, d):
    """Documents with their labels; not all have any."""
    docs = lift(_table(spark, d, "documents"), f"{P}documents", ref(f"{P}doc:", "doc_id"), {f"{P}lang": "lang", f"{P}chars": "n_chars"}, f"{P}Document")
    return docs.unionByName(lift(_table(spark, d, "labels"), f"{P}labels", ref(f"{P}doc:", "doc_id"), {f"{P}quality": "quality", f"{P}toxic": "toxic"}))


_add("shacl_mincount", _shacl(":S a sh:NodeShape ; sh:targetClass :Document ; sh:property [ sh:path :quality ; sh:minCount 1 ] .", _with_gaps),
     "SELECT doc_id AS focus, 'Violation' AS severity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_add("shacl_datatype", _shacl(":S a sh:NodeShape ; sh:targetClass :Document ; sh:property [ sh:path :lang ; sh:datatype xsd:integer ; sh:severity sh:Warning ] .", _with_gaps, True),
     "SELECT doc_id AS focus, 'Warning' AS severity, lang AS value FROM documents WHERE lang IS NOT NULL")
_add("shacl_in", _shacl(":S a sh:NodeShape ; sh:targetClass :Document ; sh:property [ sh:path :lang ; sh:in ( \"en\" \"de\" ) ] .", _with_gaps, True),
     "SELECT doc_id AS focus, 'Violation' AS severity, lang AS value FROM documents WHERE lang NOT IN ('en', 'de')")
_add("shacl_class", _shacl(":S a sh:NodeShape ; sh:targetClass :Order ; sh:property [ sh:path :customer ; sh:class :Customer ] .", lambda s, d: orders(s, d).unionByName(customers(s, d).where(F.col("g") != f"<{P}nation:3>"))),
     "SELECT o_orderkey AS focus, 'Violation' AS severity FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
_add("shacl_range", _shacl(":S a sh:NodeShape ; sh:targetClass :Part ; sh:property [ sh:path :size ; sh:minInclusive 3 ; sh:maxExclusive 48 ] .", parts, True),
     "SELECT p_partkey AS focus, 'Violation' AS severity, p_size::VARCHAR AS value FROM part WHERE p_size < 3 OR p_size >= 48")
_add("shacl_sparql", _shacl(":S a sh:NodeShape ; sh:targetClass :Order ; sh:sparql [ sh:select \"SELECT $this WHERE { GRAPH ?g { $this <urn:t:total> ?t ; <urn:t:status> 'O' . FILTER(?t > 250000) } }\" ] .", orders),
     "SELECT o_orderkey AS focus, 'Violation' AS severity FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000")


def membrane_health(spark, d):
    """Each nation's interior against one boundary, all in one plan: negative balances are violations, small ones warnings."""
    quads = customers(spark, d)
    text = _SHAPE + ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :acctbal ; sh:minInclusive -900 ] ; sh:property [ sh:path :acctbal ; sh:minInclusive -500 ; sh:severity sh:Warning ] ."
    report = shacl.validate(quads.select(F.col("g").alias("unit"), "s", "p", "o"), [q[1:] for q in turtle(text)])
    units = _table(spark, d, "nation").select(ref(f"{P}nation:", "n_nationkey").alias("unit"))
    return shacl.health(report, units).select(key("unit").alias("nation"), "health")


_add("membrane_health", membrane_health, "SELECT n_nationkey::BIGINT AS nation, CASE WHEN min(c_acctbal) < -900 THEN 'compromised' WHEN min(c_acctbal) < -500 THEN 'weakened' ELSE 'intact' END AS health FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")

# provenance
_SINCE = "2024-01-20T00:00:00"
_add("audit_trail_since", _sparql(f"SELECT ?e ?agent ?kind WHERE {{ GRAPH :context {{ ?e a prov:Activity ; prov:startedAtTime ?t ; prov:wasAssociatedWith ?agent ; :kind ?kind FILTER(?t > \"{_SINCE}Z\"^^<http://www.w3.org/2001/XMLSchema#dateTime>) }} }}", (events,), e="key", agent="key", kind="str"),
     f"SELECT event_id AS e, user_id AS agent, event_type AS kind FROM events WHERE ts > TIMESTAMP '{_SINCE}'")


def last_activity(spark, d):
    e = Compiler(spark, events(spark, d)).run(parse(_PREFIX + "SELECT ?e ?agent ?t WHERE { GRAPH :context { ?e prov:startedAtTime ?t ; prov:wasAssociatedWith ?agent } }"))
    at = F.struct(T.timestamp(F.col("t")).alias("t"), key("e").alias("e"))
    return e.groupBy(key("agent").alias("agent")).agg(F.max(at).alias("m")).select("agent", F.col("m.e").alias("event"))


_add("last_traversal", last_activity, "SELECT user_id AS agent, arg_max(event_id, (ts, event_id)) AS event FROM events GROUP BY 1")


def stale_agents(spark, d):
    e = events(spark, d)
    last = e.where(F.col("p") == f"<{PROV}startedAtTime>").join(e.where(F.col("p") == f"<{PROV}wasAssociatedWith>").select("s", F.col("o").alias("agent")), "s").groupBy(key("agent").alias("agent")).agg(F.max(T.timestamp(F.col("o"))).alias("last"))
    return last.select("agent", (F.lit("2024-01-31").cast("timestamp") - F.col("last") > F.expr("interval 24 hours")).alias("stale"))


_add("stale_agents", stale_agents, "SELECT user_id AS agent, TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 24 HOURS AS stale FROM events GROUP BY 1")
_add("activities_by_agent", _sparql("SELECT ?agent (COUNT(?e) AS ?n) WHERE { GRAPH :context { ?e prov:wasAssociatedWith ?agent } } GROUP BY ?agent", (events,), agent="key", n="int"), "SELECT user_id AS agent, count(*) AS n FROM events GROUP BY 1")

# projections


def _spo(f, spark, d):
    return once(f(spark, d).select("s", "p", "o"))


_add("strip_types", lambda s, d: projection.strip_types(_spo(customers, s, d)).groupBy("p").agg(F.count("*").alias("n")).select(F.regexp_extract("p", r":(\w+)>$", 1).alias("p"), "n"),
     "SELECT unnest(['name', 'mktsegment', 'acctbal', 'nation']) AS p, count(*) AS n FROM customer GROUP BY 1")
_add("object_properties_only", lambda s, d: projection.object_properties_only(_spo(orders, s, d)).where(F.col("p") != TYPE).select(key("s").alias("o"), key("o").alias("c")), "SELECT o_orderkey AS o, o_custkey AS c FROM orders")
_add("data_properties_only", lambda s, d: projection.data_properties_only(_spo(suppliers, s, d)).where(F.col("p") == f"<{P}acctbal>").select(key("s").alias("s"), T.number(F.col("o")).alias("bal")), "SELECT s_suppkey AS s, s_acctbal AS bal FROM supplier")
_add("labels_only", lambda s, d: projection.labels_only(_spo(parts, s, d)).select(key("s").alias("p"), T.lexical(F.col("o")).alias("label")), "SELECT p_partkey AS p, p_name AS label FROM part")
_add("filter_by_class", lambda s, d: projection.filter_by_class(_spo(lambda a, b: customers(a, b).unionByName(suppliers(a, b)), s, d), f"{P}Supplier").where(F.col("p") == f"<{P}name>").select(T.lexical(F.col("o")).alias("name")), "SELECT s_name AS name FROM supplier")
_add("localize_predicates", lambda s, d: projection.localize_predicates(_spo(parts, s, d)).groupBy(T.lexical(F.col("p")).alias("p")).agg(F.count("*").alias("n")), "SELECT 'urn:local:' || unnest(['label', 'type', 'urn:t:brand', 'urn:t:type', 'urn:t:size', 'urn:t:price']) AS p, count(*) AS n FROM part GROUP BY 1")
_add("lpg_nodes", lambda s, d: projection.lpg_nodes(_spo(customers, s, d)).select("iri", F.array_join("types", ",").alias("types"), F.get_json_object("attributes", "$.name").alias("name")),
     "SELECT 'urn:t:customer:' || c_custkey AS iri, 'urn:t:Customer' AS types, c_name AS name FROM customer UNION ALL SELECT DISTINCT 'urn:t:nation:' || c_nationkey, '', NULL FROM customer")
_add("lpg_edges", lambda s, d: projection.lpg_edges(_spo(orders, s, d)), "SELECT 'urn:t:order:' || o_orderkey AS source, 'urn:t:customer' AS predicate, 'urn:t:customer:' || o_custkey AS target FROM orders")


def collapsed(spark, d):
    o = _table(spark, d, "orders")
    quads = lift(o, f"{P}statements", ref(f"{P}statement:", "o_orderkey"), {f"{RDF}subject": ref(f"{P}customer:", "o_custkey"), f"{RDF}predicate": F.lit(f"<{P}placed>"), f"{RDF}object": ref(f"{P}order:", "o_orderkey"), f"{P}confidence": "o_totalprice"}, f"{RDF}Statement")
    return projection.collapse_reification(quads).select(key("s").alias("c"), key("o").alias("o"))


_add("collapse_reification", collapsed, "SELECT o_custkey AS c, o_orderkey AS o FROM orders")


def rdfs_types(spark, d):
    schema = spark.createDataFrame([tuple(q[1:]) for q in turtle(f"@prefix : <{P}> . @prefix rdfs: <{RDFS}> . :Customer rdfs:subClassOf :Party . :Party rdfs:subClassOf :Thing . :customer rdfs:domain :Deal ; rdfs:subPropertyOf :party . :party rdfs:range :Party .")], "s string, p string, o string")
    triples = orders(spark, d).unionByName(customers(spark, d)).select("s", "p", "o").unionByName(schema)
    return rdfs.entailed(triples).where((F.col("p") == TYPE) | (F.col("p") == f"<{P}party>")).groupBy(F.when(F.col("p") == TYPE, T.lexical(F.col("o"))).otherwise("party").alias("k")).agg(F.count("*").alias("n"))


_add("rdfs_types", rdfs_types, """SELECT * FROM (SELECT 'urn:t:Customer' AS k, count(*) AS n FROM customer UNION ALL SELECT 'urn:t:Party', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
  UNION ALL SELECT 'urn:t:Thing', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'urn:t:Order', count(*) FROM orders UNION ALL SELECT 'urn:t:Deal', count(*) FROM orders UNION ALL SELECT 'party', count(*) FROM orders)""")
_add("compose_union", lambda s, d: once(_spo(customers, s, d).unionByName(_spo(suppliers, s, d))).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects")), "SELECT (SELECT 5 * count(*) FROM customer) + (SELECT 4 * count(*) FROM supplier) AS n, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS subjects")
_add("graph_difference", lambda s, d: _spo(orders, s, d).join(Compiler(s, orders(s, d)).run(parse(_PREFIX + "CONSTRUCT { ?o ?p ?v } WHERE { GRAPH :orders { ?o :status \"F\" ; ?p ?v } }")), ["s", "p", "o"], "left_anti").agg(F.count("*").alias("n")), "SELECT 6 * count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
_add("text_round_trip", lambda s, d: Compiler(s, lift(_table(s, d, "documents"), f"{P}docs", ref(f"{P}doc:", "doc_id"), {f"{P}text": "text"})).run(parse(_PREFIX + "SELECT ?d ?t WHERE { GRAPH :docs { ?d :text ?t } }")).select(key("d").alias("doc"), F.md5(T.lexical(F.col("t"))).alias("digest")), "SELECT doc_id AS doc, md5(text) AS digest FROM documents WHERE text IS NOT NULL")

# more of SPARQL
_add("minus_unbound", _sparql("SELECT ?c ?o WHERE { GRAPH ?g { ?c a :Customer } OPTIONAL { GRAPH :orders { ?o :customer ?c ; :status \"P\" } } MINUS { GRAPH :orders { ?o :priority \"1-URGENT\" } } }", (customers, orders), c="key", o="key"),
     "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL OR o_orderpriority <> '1-URGENT'")
_BIG = 9007199254740992


def _big(spark, d):
    """Numbers around 2^53, which doubles can't tell apart."""
    return lift(_table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + _BIG).alias("n"), "o_orderstatus"), f"{P}big", ref(f"{P}order:", "o_orderkey"), {f"{P}n": "n", f"{P}status": "o_orderstatus"})


TYPES["long"] = lambda c: T.lexical(F.col(c)).cast("decimal(38,0)").cast("string")
_add("exact_integers", _sparql(f"SELECT ?o ?m WHERE {{ GRAPH :big {{ ?o :n ?n }} FILTER(?n > {_BIG + 4} || ?n = {_BIG + 1}) BIND(?n * 3 - 1 AS ?m) }}", (_big,), o="key", m="long"),
     f"SELECT o_orderkey AS o, ((o_orderkey % 7 + {_BIG}) * 3 - 1)::VARCHAR AS m FROM orders WHERE o_orderkey % 7 IN (1, 5, 6)")
_add("exact_sum", _sparql("SELECT ?s (SUM(?n) AS ?total) WHERE { GRAPH :big { ?o :n ?n ; :status ?s } } GROUP BY ?s", (_big,), s="str", total="long"),
     f"SELECT o_orderstatus AS s, sum((o_orderkey % 7 + {_BIG})::HUGEINT)::VARCHAR AS total FROM orders GROUP BY 1")
_add("from_named", _sparql("SELECT ?s (COUNT(?o) AS ?n) FROM :suppliers FROM NAMED :orders WHERE { ?x :nation ?nat . GRAPH ?g { ?o :status ?s ; :customer ?c } FILTER(?x = <urn:t:supplier:1>) } GROUP BY ?s", (customers, suppliers, orders), s="str", n="int"),
     "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
_add("time_zones", _sparql("SELECT ?z ?d (COUNT(?e) AS ?n) WHERE { GRAPH :context { ?e prov:startedAtTime ?t } BIND(TZ(?t) AS ?z) BIND(STR(TIMEZONE(?t)) AS ?d) } GROUP BY ?z ?d", (events,), z="str", d="str", n="int"),
     "SELECT 'Z' AS z, 'PT0S' AS d, count(*) AS n FROM events")
_add("path_star", _sparql("SELECT ?x ?up WHERE { GRAPH <urn:holarchy:registry> { ?x a :Holon . ?x :memberOf* ?up } }", (registry,), x="str", up="str"),
     "SELECT 'urn:t:region:' || r_regionkey AS x, 'urn:t:region:' || r_regionkey AS up FROM region UNION ALL SELECT 'urn:t:nation:' || n_nationkey, 'urn:t:nation:' || n_nationkey FROM nation UNION ALL SELECT 'urn:t:nation:' || n_nationkey, 'urn:t:region:' || n_regionkey FROM nation")
_add("optional_nested", _sparql("SELECT ?c ?o ?t WHERE { GRAPH ?g { ?c a :Customer } OPTIONAL { GRAPH :orders { ?o :customer ?c ; :status \"P\" } OPTIONAL { GRAPH :orders { ?o :total ?t } FILTER(?t > 300000) } } }", (customers, orders), c="key", o="key", t="num"),
     "SELECT c_custkey AS c, o_orderkey AS o, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_add("group_implicit", _sparql("SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?s) AS ?kinds) (MAX(?b) AS ?most) WHERE { GRAPH ?g { ?c :acctbal ?b ; :mktsegment ?s } }", (customers,), n="int", kinds="int", most="num"),
     "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, max(c_acctbal) AS most FROM customer")
_add("string_functions", _sparql("SELECT ?p ?r ?u ?i ?x WHERE { GRAPH :parts { ?p rdfs:label ?l ; :brand ?b } BIND(REPLACE(?l, \" \", \"-\") AS ?r) BIND(ENCODE_FOR_URI(CONCAT(?l, \"#/é\")) AS ?u) BIND(STRAFTER(?b, \"#\") AS ?x) BIND(STR(IRI(CONCAT(\"urn:b:\", ?x))) AS ?i) }", (parts,), p="key", r="str", u="str", i="str", x="str"),
     "SELECT p_partkey AS p, replace(p_name, ' ', '-') AS r, replace(p_name, ' ', '%20') || '%23%2F%C3%A9' AS u, 'urn:b:' || split_part(p_brand, '#', 2) AS i, split_part(p_brand, '#', 2) AS x FROM part")
_add("describe", lambda s, d: Compiler(s, customers(s, d)).run(parse(_PREFIX + "DESCRIBE ?c WHERE { GRAPH ?g { ?c :acctbal ?b FILTER(?b > 9000) } }")).groupBy(key("s").alias("c")).agg(F.count("*").alias("n")),
     "SELECT c_custkey AS c, 5::BIGINT AS n FROM customer WHERE c_acctbal > 9000")

# more of SHACL
_add("shacl_maxcount", _shacl(":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path [ sh:inversePath :customer ] ; sh:maxCount 9 ] .", lambda s, d: orders(s, d).unionByName(customers(s, d))),
     "SELECT o_custkey AS focus, 'Violation' AS severity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 9")
_add("shacl_nodekind", _shacl(":S a sh:NodeShape ; sh:targetClass :Part ; sh:property [ sh:path :type ; sh:nodeKind sh:IRI ] .", parts, True),
     "SELECT p_partkey AS focus, 'Violation' AS severity, p_type AS value FROM part")
_add("shacl_closed", _shacl(":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path :name ] ; sh:property [ sh:path :nation ] .", suppliers),
     "SELECT s_suppkey AS focus, 'Violation' AS severity FROM supplier")
_add("shacl_sparql_target", _shacl(":S a sh:NodeShape ; sh:target [ a sh:SPARQLTarget ; sh:select \"SELECT ?this WHERE { GRAPH ?g { ?this <urn:t:status> 'F' } }\" ] ; sh:property [ sh:path :total ; sh:maxInclusive 250000 ] .", orders),
     "SELECT o_orderkey AS focus, 'Violation' AS severity FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")


def shacl_sparql_units(spark, d):
    """A SPARQL constraint for every nation by itself: a customer whom its own nation's graph has with the largest balance there is a violation."""
    quads = customers(spark, d)
    text = _SHAPE + ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:sparql [ sh:select \"SELECT $this WHERE { $this <urn:t:acctbal> ?b . FILTER NOT EXISTS { ?other <urn:t:acctbal> ?more . FILTER(?more > ?b) } }\" ] ."
    report = shacl.validate(quads.select(F.col("g").alias("unit"), "s", "p", "o"), [q[1:] for q in turtle(text)])
    return report.select(key("unit").alias("nation"), key("focus").alias("customer"))


_add("shacl_sparql_units", shacl_sparql_units, "SELECT c_nationkey::BIGINT AS nation, c_custkey AS customer FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) = 1")


# the dataset facade and the store over the same tables
def _dataset(spark, d, *more):
    from trellis.dataset import GraphDataset
    from trellis.operators.store import SparkStore

    quads = registry(spark, d)
    for f in more:
        quads = quads.unionByName(f(spark, d))
    return GraphDataset(SparkStore(spark, quads), REG, load_ontology=False, metadata_updates="off", vocabulary=P)


_add("dataset_holons", lambda s, d: s.createDataFrame([(h.iri, h.label, len(h.interior_graphs)) for h in _dataset(s, d).list_holons()], "h string, label string, interiors long"), SQL["holons_with_layers"])
_add("dataset_find_path", lambda s, d: s.createDataFrame([(k, p.iri) for k, p in enumerate(_dataset(s, d).find_path(f"{P}nation:0", f"{P}nation:14"))], "step long, portal string"),
     f"WITH RECURSIVE e AS ({_ONE}), r(step, a, b) AS (SELECT 0, a, b FROM e WHERE a = 0 UNION ALL SELECT step + 1, e.a, e.b FROM r JOIN e ON e.a = r.b WHERE r.b <> 14 AND step < 25) SELECT step::BIGINT AS step, 'urn:t:portal:' || a AS portal FROM r")
_add("dataset_neighborhood", lambda s, d: s.createDataFrame([(n.key, n.depth) for n in _dataset(s, d).holon_neighborhood(f"{P}nation:0", 2).nodes], "node string, depth long"),
     f"SELECT 'urn:t:nation:' || nation AS node, distance AS depth FROM ({SQL['neighborhood']})")


def dataset_resolve(spark, d):
    from trellis.operators.scope import HasClassInInterior

    ds = _dataset(spark, d, lambda s, d: customers(s, d).where((F.col("p") != TYPE) | (key("g") % 2 == 0)))
    return spark.createDataFrame([(m.iri, m.distance) for m in ds.resolve(HasClassInInterior(f"{P}Customer"), f"{P}nation:0", 3)], "holon string, distance long")


_add("dataset_resolve", dataset_resolve, f"SELECT 'urn:t:nation:' || nation AS holon, distance FROM ({_BFS.format(edges=f'{_ONE} UNION SELECT b, a FROM ({_ONE})', depth=3)}) WHERE nation % 2 = 0 AND nation IN (SELECT c_nationkey FROM customer)")
_add("dataset_interior_classes", lambda s, d: s.createDataFrame([(c.class_iri, c.count) for c in _dataset(s, d, customers).holon_interior_classes(f"{P}nation:7")], "class string, n long"),
     "SELECT 'urn:t:Customer' AS class, count(*) AS n FROM customer WHERE c_nationkey = 7 HAVING count(*) > 0")


def dataset_validate_all(spark, d):
    """All nations against one boundary, through the facade."""
    ds = _dataset(spark, d, customers)
    ds.store.parse_into(f"{P}boundary", _SHAPE + ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :acctbal ; sh:minInclusive -900 ] ; sh:property [ sh:path :acctbal ; sh:minInclusive -500 ; sh:severity sh:Warning ] .")
    for r in _table(spark, d, "nation").select("n_nationkey").collect():  # the registry's units
        ds.store.post_graph(REG, [(f"<{P}nation:{r[0]}>", f"<{P}hasBoundary>", f"<{P}boundary>")])
    rows = [(int(h.rpartition(":")[2]), m.health.value) for h, m in ds.validate_all().items() if ":nation:" in h]
    return spark.createDataFrame(rows, "nation long, health string")


_add("dataset_validate_all", dataset_validate_all, SQL["membrane_health"])


def dataset_metadata(spark, d):
    ds = _dataset(spark, d, customers)
    ds.refresh_all_metadata()
    rows = [(int(h.rpartition(":")[2]), m.triple_count, sum(c.count for c in m.class_inventory)) for h in ds._holons() for g in ds.layers(h, "interior") if (m := ds.get_graph_metadata(g))]
    return spark.createDataFrame(rows, "g long, triples long, typed long")


_add("dataset_metadata", dataset_metadata, SQL["count_triples_by_graph"])


def store_update(spark, d):
    """The store's own update, of any number of quads, and a copied graph."""
    from trellis.operators.store import SparkStore

    store = SparkStore(spark, orders(spark, d))
    store.update(_PREFIX + "DELETE { GRAPH :orders { ?o :status \"P\" } } INSERT { GRAPH :orders { ?o :status \"pending\" } } WHERE { GRAPH :orders { ?o :status \"P\" } } ; COPY :orders TO :copy ; DELETE WHERE { GRAPH :copy { ?o :status \"F\" } }")
    return store.quads.where(F.col("p") == f"<{P}status>").groupBy(F.regexp_extract("g", r"([a-z]+)>$", 1).alias("g"), T.lexical(F.col("o")).alias("status")).agg(F.count("*").alias("n"))


_add("store_update", store_update, "SELECT g, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status, count(*) AS n FROM orders, (SELECT unnest(['orders', 'copy']) AS g) WHERE NOT (g = 'copy' AND o_orderstatus = 'F') GROUP BY 1, 2")
