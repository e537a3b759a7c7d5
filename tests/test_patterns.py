import datetime

import pytest
from pyspark.sql import functions as F

from freightloom.operators import patterns as P

EVENTS = "entity_type string, entity_id string, event string, ts date"


def day(n):
    return datetime.date(2024, 1, n)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("Product", "p", "A", day(1)), ("Warehouse", "w", "B", day(4)), ("Product", "p", "A", day(10)), ("Warehouse", "w", "B", day(20))]
    return spark.createDataFrame(rows, EVENTS)


def test_one_hit_of_two(events):
    r = P.sequence_counts(events).where("a_event = 'A'").first()
    assert (r.frequency, r.pair_count, r.source_total, r.probability, r.temporal_score) == (1, 1, 2, 0.5, 0.5)


def test_pairs_against_loops(spark):
    import random

    rnd = random.Random(5)
    rows = [("T", rnd.choice("xyz"), rnd.choice("AB"), day(rnd.randrange(1, 30))) for _ in range(60)]
    got = P.interval_pairs(spark.createDataFrame(rows, EVENTS)).count()
    want = sum(1 for a in rows for b in rows if a[1] != b[1] and 0 < (b[3] - a[3]).days <= 7)
    assert got == want > 0


def random_network(spark, seed=5):
    """Suppliers and entities of the catalogue with weekly events, linked at random; no supplier is on the y side."""
    import random

    rnd = random.Random(seed)
    entities = {t: [f"{t[0]}{k}" for k in range(3)] for t in P.ENTITY_TYPES}
    links = [(x, i, y, j) for k, x in enumerate(P.ENTITY_TYPES) for y in P.ENTITY_TYPES[k + 1 :] for i in entities[x] for j in entities[y] if rnd.random() < 0.4]
    events = [(t, i, rnd.choice("AB"), day(1) + datetime.timedelta(days=7 * w)) for t in entities for i in entities[t] for w in range(6) if rnd.random() < 0.7]
    near = {(x, i): set() for x in entities for i in entities[x]}
    for x, i, y, j in links:
        near[x, i].add((y, j))
        near[y, j].add((x, i))
    steps = [(a, b) for a in events for b in events if b[:2] in near[a[:2]] and 0 < (b[3] - a[3]).days <= 7]
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(links, "x_type string, x_id string, y_type string, y_id string"), steps, events


def test_pairs_follow_the_network(spark):
    events, network, steps, _ = random_network(spark)
    got = sorted(tuple(x) for x in P.interval_pairs(events, network).select(*P.STEP).collect())
    assert got == sorted(a + b for a, b in steps) and len(got) > 100


def test_chain_states_count_every_chain(spark):
    """Multiplicities of the states against chains joined one by one; no entity type twice in a chain."""
    import collections

    events, network, steps, rows = random_network(spark)
    pairs = P.interval_pairs(events, network).cache()
    chains = [list(s) for s in steps]
    for length in (3, 4):
        chains = [[*c, b] for c in chains for a, b in steps if a == c[-1] and b[0] not in {e[0] for e in c}]
        want = collections.Counter((*c[-2], *c[-1], c[0][2]) for c in chains)
        state = P.chain_states(pairs, length)
        got = {tuple(x)[:-1]: x["n"] for x in state.groupBy(*P.STEP, "head_event").agg(F.sum("chains").alias("n")).collect()}
        assert got == want and len(chains) > 400
        assert state.count() <= len(steps) * 2 * 10
    counted = P.chain_counts(pairs, events).where("length = 4").agg(F.sum("frequency"), F.max("probability"), F.min("temporal_score")).first()
    assert counted[0] == len(chains) and 0 < counted[1] <= 1 and counted[2] > 0


def test_empty_weeks_between_first_and_last_are_filled(spark):
    weeks = spark.createDataFrame([("Supplier", "s", day(1), 2.0), ("Supplier", "s", day(22), 4.0), ("Supplier", "t", day(8), 1.0)], "entity_type string, entity_id string, ts date, actual double")
    got = [(x.entity_id, x.ts.day, x.actual) for x in P.fill_weeks(weeks).orderBy("entity_id", "ts").collect()]
    assert got == [("s", 1, 2.0), ("s", 8, 0.0), ("s", 15, 0.0), ("s", 22, 4.0), ("t", 8, 1.0)]


def test_network_links_a_supplier_with_its_main_partners(spark, lines):
    d = lines.withColumns({"city": F.col("region"), "segment": F.lit("s")})
    net = P.entity_network(d)
    mine = net.where("x_type = 'Supplier'")
    assert mine.groupBy("x_id").count().where("count <> 5").count() == 0
    best = {x["department"]: x["category"] for x in d.groupBy("department", "category").count().orderBy("count", F.desc("category")).collect()}
    assert {x.x_id: x.y_id for x in mine.where("y_type = 'Product'").collect()} == best
    assert net.where("x_type = 'Product' and y_type = 'Shipment'").count() == d.select("category", "ship_mode").distinct().count()


def test_pairs_with_every_partner_of_a_supplier(spark):
    """interval_join_lag follows the links to all partners that share order lines, not to the main one of each type alone."""
    from freightloom.plans import ORACLE
    from freightloom.plans import patterns as plans

    rows = [(day(1), "S", c, city, "m", "g", 1.0, 1) for c, city in [("A", "x"), ("A", "x"), ("B", "y"), ("C", "y")]]
    d = spark.createDataFrame(rows, "order_date date, department string, category string, city string, ship_mode string, segment string, qty double, late int")
    net = P.entity_network(d, every=True).where("x_type = 'Supplier'")
    links = sorted((x.y_type, x.y_id) for x in net.collect())
    assert links == [("Customer", "g"), ("Order", "all"), ("Product", "A"), ("Product", "B"), ("Product", "C"), ("Shipment", "m"), ("Warehouse", "x"), ("Warehouse", "y")]
    events = spark.createDataFrame([("Supplier", "S", "A", day(1)), ("Product", "B", "B", day(8))], EVENTS)
    assert P.interval_pairs(events, net).count() == 1 and P.interval_pairs(events, P.entity_network(d)).count() == 0
    assert plans.EVERY_LINK in ORACLE["interval_join_lag"]


def test_same_entity_and_same_day_do_not_count(spark):
    e = spark.createDataFrame([("T", "x", "A", day(1)), ("T", "x", "B", day(2)), ("T", "y", "B", day(1))], EVENTS)
    assert {(r.a_entity_id, r.b_entity_id) for r in P.interval_pairs(e).collect()} == {("y", "x")}


def edge(spark, weight=0.95, last=day(1), conf=0.8):
    d = spark.createDataFrame([("Product", "p", "Warehouse", "w", "R", weight, conf, last)],
                              "source_type string, source_id string, target_type string, target_id string, rel_type string, weight double, confidence double, last_updated date")
    return d


@pytest.mark.parametrize("last, ref, want, action", [
    (datetime.date(2024, 5, 2), datetime.date(2024, 6, 1), 0.2039, "edge_decayed"),
    (datetime.date(2024, 11, 1), datetime.date(2024, 12, 1), 0.4445, "edge_decayed"),
    (datetime.date(2024, 1, 1), datetime.date(2024, 12, 1), 0.40, "edge_decayed"),
    (datetime.date(2024, 4, 1), datetime.date(2024, 6, 1), 0.0, "edge_removed"),
    (datetime.date(2024, 6, 1), datetime.date(2024, 6, 1), 0.95, "unchanged"),
])
def test_decay(spark, last, ref, want, action):
    r = P.decay_edges(edge(spark, last=last), F.lit(ref)).first()
    assert (round(r.weight, 4), r.action, r.confidence) == (want, action, 0.8)


def test_strengthen_and_activate(spark):
    p = edge(spark, 0.9).select(*P.EDGE_KEY, "weight", "confidence", F.lit(3).cast("long").alias("frequency"), F.lit(0.5).alias("temporal_score"),
                                F.lit("DEMAND_SPIKE").alias("source_event"), F.lit("INVENTORY_DROP").alias("target_event"), F.col("last_updated").alias("last_seen"))
    edges = P.new_edges(p)
    assert edges.first().status == "CANDIDATE"
    for reps in (2, 3):
        edges = P.upsert_edges(edges, p.withColumn("weight", F.lit(0.5)))
        r = edges.first()
        assert r.repetitions == reps and r.action == "edge_strengthened"
    assert r.status == "ACTIVE" and abs(r.weight - ((0.9 * 0.6 + 0.2) * 0.6 + 0.2)) < 1e-6 and r.frequency == 9 and len(r.history) == 3
    assert P.validate_edges(edges).first().reason == "ok"
    for _ in range(12):
        edges = P.upsert_edges(edges, p)
    assert len(edges.first().history) == 10


def test_importance_caps_frequency(spark):
    d = spark.createDataFrame([(0.4, 500), (0.9, 50), (0.1, 1)], "weight double, frequency long")
    assert [r[0] for r in d.select(P.importance()).collect()] == ["High", "Critical", "Low"]
