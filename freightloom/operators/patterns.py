"""Deviation events, "A then B" patterns and the life cycle of the edges inferred from them.

Events are weekly deviations of entities: suppliers, whose number grows, and dimensions of fixed size (categories, cities, shipping modes,
segments, the whole business). Events follow each other along the edges of a network of entities, so pairs are bounded by edges times events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.session import written

# Event name by entity type and direction of the deviation.
EVENT_NAMES = {
    ("Supplier", "over"): "SUPPLIER_DELAY", ("Supplier", "under"): "SUPPLIER_IMPROVEMENT",
    ("Product", "over"): "DEMAND_SPIKE", ("Product", "under"): "DEMAND_DROP",
    ("Warehouse", "over"): "INVENTORY_STRESS", ("Warehouse", "under"): "INVENTORY_DROP",
    ("Shipment", "over"): "LATE_DELIVERY", ("Shipment", "under"): "EARLY_DELIVERY",
    ("Order", "over"): "ORDER_SURGE", ("Order", "under"): "ORDER_DECLINE",
    ("Customer", "over"): "COMPLAINT_SPIKE", ("Customer", "under"): "SATISFACTION_GAIN",
}
# Relation name by (first event, second event).
CAUSAL_NAMES = {
    ("LATE_DELIVERY", "INVENTORY_DROP"): "LATE_DELIVERY_TRIGGERS_STOCKOUT",
    ("LATE_DELIVERY", "COMPLAINT_SPIKE"): "LATE_DELIVERY_CAUSES_COMPLAINT",
    ("LATE_DELIVERY", "INVENTORY_STRESS"): "LATE_DELIVERY_TRIGGERS_STOCKOUT",
    ("INVENTORY_DROP", "COMPLAINT_SPIKE"): "STOCKOUT_CAUSES_COMPLAINT",
    ("INVENTORY_DROP", "ORDER_DECLINE"): "STOCKOUT_SUPPRESSES_ORDERS",
    ("DEMAND_SPIKE", "SUPPLIER_DELAY"): "DEMAND_SPIKE_AMPLIFIES_SUPPLIER_RISK",
    ("DEMAND_SPIKE", "INVENTORY_DROP"): "DEMAND_SPIKE_DEPLETES_INVENTORY",
    ("DEMAND_SPIKE", "INVENTORY_STRESS"): "DEMAND_SPIKE_DEPLETES_INVENTORY",
    ("SUPPLIER_DELAY", "INVENTORY_DROP"): "SUPPLIER_DELAY_CAUSES_STOCKOUT",
    ("SUPPLIER_DELAY", "INVENTORY_STRESS"): "SUPPLIER_DELAY_CAUSES_STOCKOUT",
    ("SUPPLIER_DELAY", "LATE_DELIVERY"): "SUPPLIER_DELAY_CASCADES_TO_DELIVERY",
    ("INVENTORY_STRESS", "LATE_DELIVERY"): "INVENTORY_STRESS_DELAYS_SHIPMENT",
    ("INVENTORY_STRESS", "COMPLAINT_SPIKE"): "INVENTORY_STRESS_CAUSES_COMPLAINT",
    ("ORDER_SURGE", "INVENTORY_STRESS"): "ORDER_SURGE_STRESSES_INVENTORY",
    ("ORDER_SURGE", "SUPPLIER_DELAY"): "ORDER_SURGE_OVERLOADS_SUPPLIER",
}
# Which event may follow which, and the entity type each event needs on either side.
TRANSITIONS = {
    "SUPPLIER_DELAY": ("DEMAND_SPIKE", "INVENTORY_DROP"), "DEMAND_SPIKE": ("SUPPLIER_DELAY", "INVENTORY_DROP"),
    "INVENTORY_DROP": ("DEMAND_SPIKE", "SUPPLIER_DELAY"), "LATE_DELIVERY": ("CUSTOMER_CHURN",),
}
SOURCE_TYPES = {"SUPPLIER_DELAY": "Supplier", "DEMAND_SPIKE": "Product", "INVENTORY_DROP": "Warehouse", "LATE_DELIVERY": "Shipment"}
TARGET_TYPES = {"DEMAND_SPIKE": "Product", "INVENTORY_DROP": "Warehouse", "SUPPLIER_DELAY": "Supplier", "CUSTOMER_CHURN": "Customer"}

LAG_DAYS, WINDOW_DAYS = 7, 30
MIN_FREQUENCY, MIN_CONFIDENCE = 3, 0.7
DECAY_RATE, MIN_WEIGHT, SEASON_FLOOR = 0.05, 0.1, 0.40
EDGE_KEY = ["source_type", "source_id", "target_type", "target_id", "rel_type"]


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def lookup(table: dict, keys: list[Column], default: Column) -> Column:
    """Fixed lookup table as a native map expression."""
    pairs = [F.lit(x) for k, v in table.items() for x in ("|".join(k) if isinstance(k, tuple) else k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", *keys)), default)


# Entity types of fixed size with the column that names the entity and the measure of a week; the whole business is one entity.
CATALOGUE = {"Product": ("category", "qty"), "Warehouse": ("city", "qty"), "Shipment": ("ship_mode", "late"), "Customer": ("segment", "qty"), "Order": (None, "qty")}
ENTITY_TYPES = ["Supplier", *CATALOGUE]
WHOLE = "all"


def _entity_id(entity_type: str) -> Column:
    column = CATALOGUE[entity_type][0]
    return F.col(column) if column else F.lit(WHOLE)


def fill_weeks(weeks: DataFrame) -> DataFrame:
    """Weeks without activity between an entity's first and last one, with the measure 0: each row is followed by the empty weeks after it."""
    after = F.lead("ts").over(Window.partitionBy("entity_type", "entity_id").orderBy("ts"))
    until = F.coalesce(F.date_sub("_after", 7), F.col("ts"))
    each = weeks.withColumn("_after", after).withColumn("week", F.explode(F.sequence(F.col("ts"), until, F.expr("INTERVAL 7 DAYS"))))
    return each.select("entity_type", "entity_id", F.col("week").alias("ts"), F.when(F.col("week") == F.col("ts"), F.col("actual")).otherwise(0.0).alias("actual"))


def entity_weeks(df: DataFrame) -> DataFrame:
    """Weekly measure per entity from its first to its last week: late lines for suppliers and shipping modes, quantity for all others.

    Lines are grouped once at the finest grain of the catalogue, from which its five entity types are read off; suppliers grow in number with the
    business and are grouped by themselves.
    """
    week = F.date_trunc("week", "order_date").cast("date").alias("ts")
    g = df.groupBy(week, "category", "city", "ship_mode", "segment").agg(F.sum("qty").alias("qty"), F.sum("late").cast("double").alias("late"))
    one = lambda t, v: F.struct(F.lit(t).alias("entity_type"), _entity_id(t).alias("entity_id"), F.col(v).alias("v"))
    kinds = F.array(*[one(t, v) for t, (_, v) in CATALOGUE.items()])
    small = g.select("ts", F.explode(kinds).alias("e")).groupBy("e.entity_type", "e.entity_id", "ts").agg(F.sum("e.v").alias("actual"))
    suppliers = df.groupBy(F.lit("Supplier").alias("entity_type"), F.col("department").alias("entity_id"), week).agg(F.sum("late").cast("double").alias("actual"))
    return fill_weeks(small.unionByName(suppliers))


def entity_network(df: DataFrame, every: bool = False) -> DataFrame:
    """Undirected edges x - y between entities of different types, y from the catalogue: x_type, x_id, y_type, y_id.

    Entities of the catalogue are linked if they share order lines. A supplier is linked with its main partner of each type, the one it shares most
    lines with (the first by name on a tie): its lines reach nearly the whole catalogue, so any shared line would link all with all. Edges grow with the
    suppliers, by five each, and not with the lines. With `every` a supplier is linked with all partners it shares order lines with.
    """
    named = [(t, _entity_id(t)) for t in CATALOGUE]
    pair = lambda x, y: F.struct(F.lit(x[0]).alias("x_type"), x[1].alias("x_id"), F.lit(y[0]).alias("y_type"), y[1].alias("y_id"))
    pairs = F.array(*[pair(x, y) for i, x in enumerate(named) for y in named[i + 1 :]])
    shared = df.select("category", "city", "ship_mode", "segment").distinct().select(F.inline(pairs)).distinct()
    partners = F.array(*[F.struct(F.lit(t).alias("y_type"), i.alias("y_id")) for t, i in named])
    counts = df.select(F.col("department").alias("x_id"), F.inline(partners)).groupBy("x_id", "y_type", "y_id").agg(F.count(F.lit(1)).alias("n"))
    main = counts if every else counts.groupBy("x_id", "y_type").agg(F.min_by("y_id", F.struct(-F.col("n"), F.col("y_id"))).alias("y_id"))
    return shared.unionByName(main.select(F.lit("Supplier").alias("x_type"), "x_id", "y_type", "y_id"))


def with_forecast(weeks: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity_type", "entity_id").orderBy("ts").rowsBetween(-3, -1)
    return weeks.withColumn("predicted", F.when(F.count("actual").over(w) == 3, F.avg("actual").over(w)))


def deviation_join(forecasts: DataFrame, actuals: DataFrame, floor: float = 0.10) -> DataFrame:
    """Match forecasts to actuals on entity and date; keep deviations of at least `floor`."""
    d = forecasts.where("predicted IS NOT NULL").join(actuals, ["entity_type", "entity_id", "ts"])
    gap = F.col("actual") - F.col("predicted")
    pct = F.coalesce(F.abs(F.try_divide(gap, F.col("predicted"))), F.lit(0.0))
    return d.withColumns({"deviation": gap, "deviation_pct": pct}).where(F.col("deviation_pct") >= floor)


def classify(events: DataFrame) -> DataFrame:
    side = F.when(F.col("deviation") > 0, "over").otherwise("under")
    return events.withColumn("event", lookup(EVENT_NAMES, [F.col("entity_type"), side], F.lit("DEVIATION")))


def deviation_events(df: DataFrame) -> DataFrame:
    """Classified weekly deviations: entity_type, entity_id, ts, event, predicted, actual, deviation, deviation_pct."""
    f = with_forecast(entity_weeks(df))
    return classify(deviation_join(f.drop("actual"), f.drop("predicted")))


def window_filter(events: DataFrame, days: int, back: int = 0) -> DataFrame:
    """Events within `days` before the reference, which lies `back` days before the latest event."""
    ref = F.date_sub(events.agg(F.max("ts")).scalar(), back)
    return events.withColumn("_ref", ref).where("ts >= date_sub(_ref, %d) AND ts <= _ref" % days).drop("_ref")


EVENT = ["entity_type", "entity_id", "event", "ts"]


def time_slot(ts: str, lag: int) -> Column:
    """Buckets as wide as the lag: what follows within the lag lies in the same bucket or the next."""
    return F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / lag)


def interval_pairs(events: DataFrame, network: DataFrame | None = None, lag: int = LAG_DAYS) -> DataFrame:
    """Pairs of events of entities linked in the network, the second within (ts, ts + lag days] of the first.

    An event is dealt to its entity's edges, so pairs are bounded by edges times events. The dealt side is the x side of the edges, whose entities have few
    edges each; the join that follows finds the events of y by entity and time bucket and serves both directions. Without a network all
    entities but the event's own are linked, which only suits few events.
    """
    if network is None:
        slot = time_slot("ts", lag)
        a = events.select(*[F.col(c).alias(f"a_{c}") for c in EVENT], F.explode(F.array(slot, slot + 1)).alias("slot"))
        b = events.select(*[F.col(c).alias(f"b_{c}") for c in EVENT], slot.alias("slot"))
        near = (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.date_add("a_ts", lag)) & (F.col("a_entity_id") != F.col("b_entity_id"))
        return a.join(b, "slot").where(near).drop("slot")
    x = events.select(F.col("entity_type").alias("x_type"), F.col("entity_id").alias("x_id"), F.col("event").alias("x_event"), F.col("ts").alias("x_ts"))
    y = events.select(F.col("entity_type").alias("y_type"), F.col("entity_id").alias("y_id"), F.col("event").alias("y_event"), F.col("ts").alias("y_ts"), time_slot("ts", lag).alias("slot"))
    # Only events of y sides can match. Where these are the catalogue's they are few, which the planner sees by the size of their files.
    y = written(y.join(network.select("y_type", "y_id").distinct(), ["y_type", "y_id"], "left_semi"), "later-events")
    slot = time_slot("x_ts", lag)
    dealt = x.join(network, ["x_type", "x_id"]).withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    gap = F.datediff("y_ts", "x_ts")
    both = dealt.join(y, ["y_type", "y_id", "slot"]).where((F.abs(gap) <= lag) & (gap != 0))
    first = lambda c, other: F.when(gap > 0, F.col(c)).otherwise(F.col(other))
    sides = (("entity_type", "type"), ("entity_id", "id"), ("event", "event"), ("ts", "ts"))
    return both.select(*[first(f"x_{c}", f"y_{c}").alias(f"a_{n}") for n, c in sides], *[first(f"y_{c}", f"x_{c}").alias(f"b_{n}") for n, c in sides])


STEP = [f"{side}_{c}" for side in "ab" for c in EVENT]


def chain_states(steps: DataFrame, length: int) -> DataFrame:
    """Chains of `length` events along the network by their last step: the step's columns, seen, head_event, chains.

    A chain takes each step within the lag of the one before and meets no entity type twice. Chains are never written out: a state is a step with the
    set of types met (bits) and the kind of the first event, and `chains` is how many chains end in it. A turn adds up the states that end in an event and
    hands the sum to every step that starts there, so states are bounded by steps times a fixed number of sets and kinds.
    """
    bit = lambda side: lookup({t: 1 << k for k, t in enumerate(ENTITY_TYPES)}, [F.col(f"{side}_entity_type")], F.lit(0))
    state = steps.select(*STEP, (bit("a") + bit("b")).alias("seen"), F.col("a_event").alias("head_event"), F.lit(1).cast("long").alias("chains"))
    for _ in range(length - 2):
        ends = state.groupBy(*[F.col(f"b_{c}").alias(f"a_{c}") for c in EVENT], "seen", "head_event").agg(F.sum("chains").alias("chains"))
        state = steps.join(ends, [f"a_{c}" for c in EVENT]).where(F.col("seen").bitwiseAND(bit("b")) == 0).withColumn("seen", F.col("seen") + bit("b"))
    return state


SEQUENCE = ["a_event", "b_event", "a_entity_type", "a_entity_id", "b_entity_type", "b_entity_id"]


def regularity(hits: DataFrame, keys: list[str], ts: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """1 / (1 + CV of the gaps) plus a bonus of at most 0.2 for the span; 0.5 for a single hit."""
    gap = F.datediff(F.col(ts), F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)))
    g = hits.withColumn("_gap", gap).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_gap").alias("_m"), F.stddev_pop("_gap").alias("_s"),
        F.datediff(F.max(ts), F.min(ts)).alias("_span"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )
    steady = 1 / (1 + F.try_divide("_s", "_m")) + F.least(F.col("_span") / (window_days * 2), F.lit(0.2))
    score = F.when(F.col("_n") < 2, 0.5).when(F.col("_m") == 0, 1.0).otherwise(F.least(steady, F.lit(1.0)))
    return g.select(*keys, r(score).alias("temporal_score"), "first_seen", "last_seen")


def sequence_counts(events: DataFrame, network: DataFrame | None = None, lag: int = LAG_DAYS, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Per (A, B, entities): pairs, A events followed by a B, all A events, P(B given A) and regularity."""
    hits = interval_pairs(events, network, lag).groupBy(*SEQUENCE, "a_ts").agg(F.count(F.lit(1)).alias("pairs"))
    n = hits.groupBy(*SEQUENCE).agg(F.count(F.lit(1)).alias("frequency"), F.sum("pairs").alias("pair_count"))
    total = events.groupBy(
        F.col("event").alias("a_event"), F.col("entity_type").alias("a_entity_type"), F.col("entity_id").alias("a_entity_id")
    ).agg(F.count(F.lit(1)).alias("source_total"))
    d = n.join(total, ["a_event", "a_entity_type", "a_entity_id"]).withColumn("probability", r(F.col("frequency") / F.col("source_total")))
    return d.join(regularity(hits, SEQUENCE, "a_ts", window_days), SEQUENCE)


CHAIN = ["length", "head_event", *SEQUENCE]


def chain_counts(steps: DataFrame, events: DataFrame, lengths=(2, 3, 4), window_days: int = WINDOW_DAYS) -> DataFrame:
    """Chains by length, kind of the first event and last step (events and entities): how many there are, how many of the chains up to A are followed by B, their
    share (the probability of B after such a chain) and the regularity of the days of A."""
    out = None
    for n in lengths:
        state = chain_states(steps, n)
        hits = state.groupBy(*SEQUENCE, "head_event", "a_ts").agg(F.sum("chains").alias("chains"), F.count_distinct("b_ts").alias("ends")).withColumn("length", F.lit(n))
        # chains counts each chain up to A once for every B that follows; all B of an entity and kind follow the same chains.
        hits = hits.withColumn("followed", (F.col("chains") / F.col("ends")).cast("long"))
        if n == 2:
            before = events.groupBy(*[F.col(c).alias(f"a_{c}") for c in EVENT[:3]]).agg(F.count(F.lit(1)).alias("source_total")).withColumn("head_event", F.col("a_event"))
        else:
            before = chain_states(steps, n - 1).groupBy(*[F.col(f"b_{c}").alias(f"a_{c}") for c in EVENT[:3]], "head_event").agg(F.sum("chains").alias("source_total"))
        one = hits.groupBy(*CHAIN).agg(F.sum("chains").alias("frequency"), F.sum("followed").alias("followed"))
        one = one.join(before, ["a_entity_type", "a_entity_id", "a_event", "head_event"]).join(regularity(hits, CHAIN, "a_ts", window_days), CHAIN)
        out = one if out is None else out.unionByName(one)
    return out.select(*CHAIN, "frequency", "followed", "source_total", r(F.col("followed") / F.col("source_total")).alias("probability"), "temporal_score", "first_seen", "last_seen")


def causal_label(a: Column, b: Column) -> Column:
    return lookup(CAUSAL_NAMES, [a, b], F.concat(a, F.lit("_INFLUENCES_"), b))


def detect_patterns(
    events: DataFrame, network: DataFrame | None = None, window_days: int = WINDOW_DAYS, back: int = 0,
    min_frequency: int = MIN_FREQUENCY, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Sequences past both gates with weight 0.40 P + 0.35 frequency / max + 0.25 regularity."""
    s = sequence_counts(window_filter(events, window_days, back), network, window_days=window_days).where(
        (F.col("frequency") >= min_frequency) & (F.col("probability") >= min_confidence)
    )
    top = s.agg(F.max("frequency")).scalar()
    weight = F.least(0.40 * F.col("probability") + 0.35 * (F.col("frequency") / top) + 0.25 * F.col("temporal_score"), F.lit(1.0))
    return s.select(
        F.col("a_entity_type").alias("source_type"), F.col("a_entity_id").alias("source_id"),
        F.col("b_entity_type").alias("target_type"), F.col("b_entity_id").alias("target_id"),
        F.col("a_event").alias("source_event"), F.col("b_event").alias("target_event"),
        causal_label(F.col("a_event"), F.col("b_event")).alias("rel_type"), r(weight).alias("weight"),
        F.col("probability").alias("confidence"), "frequency", "temporal_score", "first_seen", "last_seen",
    )


def new_edges(patterns: DataFrame) -> DataFrame:
    """Edge rows as they look right after creation; of several patterns for a key the heaviest counts."""
    best = F.max_by(F.struct("weight", "confidence", "temporal_score", "source_event", "target_event"),
                    F.struct("weight", "confidence", "source_event", "target_event")).alias("b")
    g = patterns.groupBy(*EDGE_KEY).agg(best, F.sum("frequency").alias("frequency"), F.max("last_seen").alias("last_updated"))
    return g.select(*EDGE_KEY, "b.*", "frequency", "last_updated", F.lit(1).alias("repetitions"), F.lit("CANDIDATE").alias("status"),
                    F.array(F.struct(F.col("last_updated").alias("ts"), F.col("b.weight").alias("weight"))).alias("history"))


def upsert_edges(edges: DataFrame, patterns: DataFrame, keep: int = 10) -> DataFrame:
    """Create or strengthen edges: weight min(0.6 old + 0.4 new, 1), summed frequency, one more repetition,
    ACTIVE from three repetitions with confidence 0.70; the last ten weights stay in the history."""
    old, new = edges.alias("o"), new_edges(patterns).alias("n")
    d = old.join(new, EDGE_KEY, "full_outer")
    both = F.col("o.weight").isNotNull() & F.col("n.weight").isNotNull()
    only_new = F.col("o.weight").isNull()
    weight = F.when(both, r(F.least(F.col("o.weight") * 0.6 + F.col("n.weight") * 0.4, F.lit(1.0)))).otherwise(F.coalesce("o.weight", "n.weight"))
    reps = F.when(both, F.col("o.repetitions") + 1).otherwise(F.coalesce("o.repetitions", "n.repetitions"))
    status = F.when(both & (F.col("o.repetitions") + 1 >= 3) & (F.col("n.confidence") >= 0.70), "ACTIVE").otherwise(F.coalesce("o.status", "n.status"))
    entry = F.array(F.struct(F.col("n.last_updated").alias("ts"), weight.alias("weight")))
    longer = F.concat("o.history", entry)
    history = F.when(both, F.when(F.size(longer) > keep, F.slice(longer, -keep, keep)).otherwise(longer)).otherwise(F.coalesce("o.history", "n.history"))
    return d.select(
        *EDGE_KEY, F.when(both, "edge_strengthened").when(only_new, "edge_created").otherwise("unchanged").alias("action"),
        F.col("o.weight").alias("weight_before"), weight.alias("weight"), F.coalesce("n.confidence", "o.confidence").alias("confidence"),
        F.coalesce("n.temporal_score", "o.temporal_score").alias("temporal_score"),
        F.coalesce("n.source_event", "o.source_event").alias("source_event"), F.coalesce("n.target_event", "o.target_event").alias("target_event"),
        (F.coalesce("o.frequency", F.lit(0)) + F.coalesce("n.frequency", F.lit(0))).alias("frequency"),
        F.coalesce("n.last_updated", "o.last_updated").alias("last_updated"), reps.alias("repetitions"), status.alias("status"),
        (F.coalesce("n.confidence", "o.confidence") >= 0.70).cast("int").alias("is_stable"), history.alias("history"),
    )


def decay_edges(edges: DataFrame, reference: Column, rate: float = DECAY_RATE) -> DataFrame:
    """weight x (1 - rate)^days since the last update; November and December decay at half the rate and stop at 0.40.

    Confidence and regularity stay as observed. Edges below 0.1 are marked for removal.
    """
    days = F.datediff(reference, "last_updated")
    season = F.month(reference).isin(11, 12)
    left = F.col("weight") * F.pow(F.lit(1.0) - F.when(season, rate * 0.5).otherwise(rate), days)
    w = F.when(days < 1, F.col("weight")).otherwise(r(F.when(season, F.greatest(left, F.lit(SEASON_FLOOR))).otherwise(left)))
    action = F.when(days < 1, "unchanged").when(w < MIN_WEIGHT, "edge_removed").otherwise("edge_decayed")
    return edges.withColumns({"weight_before": F.col("weight"), "weight": F.when(action == "edge_removed", 0.0).otherwise(w), "action": action})


def validate_edges(edges: DataFrame) -> DataFrame:
    """Accepted flag and reason by allowed transition and entity types."""
    a, b = F.col("source_event"), F.col("target_event")
    known = a.isin(*TRANSITIONS)
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        allowed = allowed | ((a == source) & b.isin(*targets))
    want_a = lookup(SOURCE_TYPES, [a], F.col("source_type"))
    want_b = lookup(TARGET_TYPES, [b], F.col("target_type"))
    reason = (
        F.when(~known, "unknown_source_event").when(~allowed, "unknown_transition")
        .when(want_a != F.col("source_type"), "wrong_source_type").when(want_b != F.col("target_type"), "wrong_target_type").otherwise("ok")
    )
    return edges.withColumns({"reason": reason, "accepted": (reason == "ok").cast("int")})


def importance(weight: str = "weight", frequency: str = "frequency") -> Column:
    s = F.col(weight) * 0.6 + F.least(F.col(frequency) / 50.0, F.lit(1.0)) * 0.4
    return F.when(s >= 0.75, "Critical").when(s >= 0.50, "High").when(s >= 0.25, "Medium").otherwise("Low")


def feedback_adjust(edges: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence +0.10 when confirmed, -0.20 when rejected, within [0, 1]; below 0.50 an edge is a candidate again."""
    d = edges.join(feedback, keys)
    c = F.greatest(F.least(F.col("confidence") + F.when(F.col("correct") == 1, 0.10).otherwise(-0.20), F.lit(1.0)), F.lit(0.0))
    return d.withColumn("new_confidence", r(c)).withColumn("new_status", F.when(c < 0.50, "CANDIDATE").otherwise("ACTIVE"))
