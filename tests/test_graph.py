import pytest
from pyspark.sql import functions as F

from freightloom.functions.scalars import node_id, normalize_entity, slugify
from freightloom.operators import graph_score as S
from freightloom.operators import graph_walk as G


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(x, "N", x, r) for x, r in zip("abcde", (0.1, 0.5, 0.9, 0.3, 0.0))], "node_id string, label string, name string, risk double")
    edges = spark.createDataFrame([("a", "b", "SUPPLIES", 0.5), ("b", "c", "INFLUENCES", 1.0), ("c", "d", "OTHER", 0.25), ("a", "c", "SUPPLIES", 0.1)],
                                  "src string, dst string, rel_type string, strength double")
    return nodes, edges


def start(nodes, x):
    return nodes.where(F.col("node_id") == x).select("node_id")


def test_components_and_orphan(graph):
    n, e = graph
    c = {r.node_id: r.component for r in G.connected_components(n, e.where("strength > 0.2")).collect()}
    assert c == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}


def test_long_chain_is_one_component(spark):
    ids = [f"{i:03d}" for i in range(40)]
    n = spark.createDataFrame([(i,) for i in ids], "node_id string")
    e = spark.createDataFrame(list(zip(ids[1:], ids[:-1])), "src string, dst string")
    assert G.connected_components(n, e).select("component").distinct().count() == 1


def test_reach(graph):
    n, e = graph
    d = {r.node_id: (r.depth, r.trust) for r in G.reach(G.orient(e.where("strength > 0.2")), start(n, "a"), 5).collect()}
    assert d == {"a": (0, 1.0), "b": (1, 1.0), "c": (2, 0.9), "d": (3, 0.5)}
    assert {r.node_id for r in G.reach(G.orient(e, "in"), start(n, "d"), 1).collect()} == {"d", "c"}


def test_paths(graph):
    n, e = graph
    short = {r.node_id: (r.hops, r.path) for r in G.shortest_paths(G.orient(e), start(n, "a"), 4).collect()}
    assert short["d"] == (2, ["a", "c", "d"])
    cheap = {r.node_id: (r.cost, r.path) for r in G.weighted_paths(G.orient(e), start(n, "a"), 4).collect()}
    assert cheap["c"] == (3.0, ["a", "b", "c"]) and cheap["d"] == (7.0, ["a", "b", "c", "d"])
    # one hop only: the direct but weak edge is all there is
    assert {r.node_id: r.cost for r in G.weighted_paths(G.orient(e), start(n, "a"), 1).collect()}["c"] == 10.0


def test_riskiest_chain_and_confidence(graph):
    n, e = graph
    c = S.chains(n, e, start(n, "d"), 4)
    best = c.first()
    assert best.path == ["b", "c", "d"] and abs(best.total - 1.7) < 1e-9
    conf = {r.chain_id: r for r in S.chain_confidence(c, n).collect()}["b>c>d"]
    want = (min(1, 0.5 + 0.2) + min(1, 0.9 * 0.7 + 0.2) + min(1, 0.3 * 0.49 + 0.2)) / 3
    assert abs(conf.confidence - want) < 1e-6 and conf.root_cause == "b"


def test_pagerank_against_loops(graph):
    n, e = graph
    pairs = [(r.src, r.dst) for r in e.collect()]
    pr = {x: 0.2 for x in "abcde"}
    for _ in range(3):
        pr = {x: 0.15 + 0.85 * sum(pr[s] / sum(1 for q in pairs if q[0] == s) for s, d in pairs if d == x) for x in pr}
    got = {r.node_id: r["rank"] for r in G.pagerank(n, e).collect()}
    assert all(abs(got[x] - pr[x]) < 1e-9 for x in pr)


def test_hub_degree(spark):
    e = spark.createDataFrame([(f"o{i}", "hub") for i in range(50)] + [("hub", "c")], "src string, dst string")
    d = {r.node_id: (r.n_in, r.n_out, r.degree) for r in G.degrees(e).collect()}
    assert d["hub"] == (50, 1, 51) and d["c"] == (1, 0, 1)


def test_names(spark):
    import hashlib

    r = spark.createDataFrame([(" NEW_york  city ",), ("  ",)], "x string").select(
        normalize_entity("x").alias("n"), slugify("x").alias("s"), node_id("Warehouse", "x").alias("i")).collect()
    assert (r[0].n, r[0].s, r[1].n) == ("New York City", "new_york_city", None)
    assert r[0].i == hashlib.md5(b"Warehouse: NEW_york  city ").hexdigest()[:12]


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(5)
    ids = [f"{i:04d}" for i in range(400)]
    rnd.shuffle(ids)
    pairs = [(ids[i], ids[i + 1]) for i in range(0, 150)] + [tuple(rnd.sample(ids[160:], 2)) for _ in range(170)] + [(ids[200], ids[200]), (ids[399], "absent"), ("absent", ids[398])]
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    n, e = spark.createDataFrame([(i,) for i in ids], "node_id string"), spark.createDataFrame(pairs, "src string, dst string")
    got = [(r.node_id, r.component) for r in G.connected_components(n, e).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in ids)


def test_repeated_edges_do_not_change_paths(graph):
    n, e = graph
    twice = G.orient(e.unionByName(e))
    once = G.orient(e)
    for walk in (lambda a: G.shortest_paths(a, start(n, "a"), 4), lambda a: G.risky_paths(a, start(n, "d"), n.select("node_id", "risk"), 3)):
        assert sorted(map(str, walk(twice).collect())) == sorted(map(str, walk(once).collect()))


def test_marked_first_lines_are_those_found_by_sorting(spark, tmp_path):
    from freightloom.operators import graph_build as B
    from freightloom.sources import canonical

    rows = [(o, 9 - i, i, 1, "2000-01-0%d" % (i + 1), float(i), "c%d" % i) for o in range(20) for i in range(o % 4 + 1)]
    d = spark.createDataFrame(rows, "order_id long, line_no int, product_id long, supplier_id long, l_shipdate string, qty double, category string")
    marked = canonical.with_first_lines(d)
    key = lambda x: sorted((r.order_id, r.qty, r.category) for r in x.collect())
    assert key(B.first_lines(marked)) == key(B.first_lines(d))
    assert "SortAggregate" not in B.first_lines(marked)._jdf.queryExecution().toString()
