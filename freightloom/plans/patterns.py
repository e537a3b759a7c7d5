"""Pattern mining and edge life cycle."""

from pyspark.sql import functions as F

from freightloom.functions.scalars import ratio
from freightloom.operators import patterns as P
from freightloom.operators.analytics import r
from freightloom.plans.registry import over_items, register, with_views
from freightloom.session import checkpoint, stored_table
from freightloom.sources import known_lines

COLS = "order_date department category city ship_mode segment qty late"


def case_sql(table, key, default):
    rows = " ".join(f"WHEN '{'|'.join(k) if isinstance(k, tuple) else k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {rows} ELSE {default} END"


_WK = "date_trunc('week', order_date)::date"
_IDS = {t: c or f"'{P.WHOLE}'" for t, (c, _) in P.CATALOGUE.items()}
ACTIVE_WEEKS = " UNION ALL ".join(
    f"SELECT '{t}' AS entity_type, {i} AS entity_id, {_WK} AS ts, CAST(sum({v}) AS DOUBLE) AS actual FROM oi GROUP BY ALL"
    for t, i, v in [("Supplier", "department", "late"), *[(t, _IDS[t], v) for t, (_, v) in P.CATALOGUE.items()]]
)
WEEKS = """SELECT entity_type, entity_id, ts, coalesce(actual, 0.0) AS actual FROM (
  SELECT entity_type, entity_id, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY))::date AS ts FROM active GROUP BY entity_type, entity_id)
LEFT JOIN active USING (entity_type, entity_id, ts)"""
_TYPES = list(P.CATALOGUE)
_SHARED = " UNION ALL ".join(
    f"SELECT DISTINCT '{x}' AS x_type, {_IDS[x]} AS x_id, '{y}' AS y_type, {_IDS[y]} AS y_id FROM oi" for k, x in enumerate(_TYPES) for y in _TYPES[k + 1 :]
)
# Suppliers linked with every partner they share order lines with.
EVERY_LINK = " UNION ALL ".join([_SHARED, *[f"SELECT DISTINCT 'Supplier', department, '{t}', {i} FROM oi" for t, i in _IDS.items()]])
NETWORK = _SHARED + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT 'Supplier', department, '{t}', {i} FROM oi GROUP BY department, {i}
    QUALIFY row_number() OVER (PARTITION BY department ORDER BY count(*) DESC, {i}) = 1""" if P.CATALOGUE[t][0] else f"SELECT DISTINCT 'Supplier', department, '{t}', {i} FROM oi"
    for t, i in _IDS.items()
)
LINKS = "SELECT x_type AS a_type, x_id AS a_id, y_type AS b_type, y_id AS b_id FROM net UNION ALL SELECT y_type, y_id, x_type, x_id FROM net"
DEV = f"""
SELECT *, {case_sql(P.EVENT_NAMES, "(entity_type || '|' || CASE WHEN deviation > 0 THEN 'over' ELSE 'under' END)", "'DEVIATION'")} AS event FROM (
  SELECT *, actual - predicted AS deviation, abs((actual - predicted) / nullif(predicted, 0)) AS deviation_pct
  FROM (SELECT *, CASE WHEN count(actual) OVER w = 3 THEN avg(actual) OVER w END AS predicted FROM weeks
        WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE predicted IS NOT NULL)
WHERE deviation_pct >= 0.10"""
BASE = {"active": ACTIVE_WEEKS, "weeks": WEEKS, "dev": DEV, "net": NETWORK, "links": LINKS}
SEQ = "a_event, b_event, a_entity_type, a_entity_id, b_entity_type, b_entity_id"


def pairs_sql(events: str) -> str:
    return f"""SELECT a.entity_type AS a_entity_type, a.entity_id AS a_entity_id, a.event AS a_event, a.ts AS a_ts,
      b.entity_type AS b_entity_type, b.entity_id AS b_entity_id, b.event AS b_event, b.ts AS b_ts
      FROM (SELECT *, unnest([0, 1]) + date_diff('day', DATE '1970-01-01', ts) // 7 AS slot FROM {events}) a JOIN links ON a_type = a.entity_type AND a_id = a.entity_id
      JOIN (SELECT *, date_diff('day', DATE '1970-01-01', ts) // 7 AS slot FROM {events}) b ON b.entity_type = b_type AND b.entity_id = b_id AND b.slot = a.slot
      WHERE b.ts > a.ts AND b.ts <= a.ts + 7"""


def window_sql(days: int, back: int = 0) -> str:
    ref = f"((SELECT max(ts) FROM dev) - {back})"
    return f"SELECT * FROM dev WHERE ts >= {ref} - {days} AND ts <= {ref}"


def sequence_views(p: str, days: int, back: int = 0, window: str | None = None) -> dict[str, str]:
    return {
        f"{p}ev": window or window_sql(days, back),
        f"{p}hits": f"SELECT {SEQ}, a_ts, count(*) AS pairs FROM ({pairs_sql(p + 'ev')}) GROUP BY ALL",
        f"{p}gaps": f"SELECT *, date_diff('day', lag(a_ts) OVER (PARTITION BY {SEQ} ORDER BY a_ts), a_ts) AS gap FROM {p}hits",
        f"{p}seq": f"""SELECT s.*, source_total, round(frequency / source_total, 6) AS probability,
            round(CASE WHEN frequency < 2 THEN 0.5 WHEN m = 0 THEN 1.0 ELSE least(1 / (1 + sd / m) + least(span / {days * 2}, 0.2), 1.0) END, 6) AS temporal_score
            FROM (SELECT {SEQ}, count(*) AS frequency, CAST(sum(pairs) AS BIGINT) AS pair_count, avg(gap) AS m, stddev_pop(gap) AS sd,
                    date_diff('day', min(a_ts), max(a_ts)) AS span, min(a_ts) AS first_seen, max(a_ts) AS last_seen FROM {p}gaps GROUP BY {SEQ}) s
            JOIN (SELECT event AS a_event, entity_type AS a_entity_type, entity_id AS a_entity_id, count(*) AS source_total FROM {p}ev GROUP BY ALL)
            USING (a_event, a_entity_type, a_entity_id)""",
    }


LABEL = case_sql(P.CAUSAL_NAMES, "(a_event || '|' || b_event)", "a_event || '_INFLUENCES_' || b_event")


def pattern_views(p: str, days: int, back: int = 0) -> dict[str, str]:
    return {
        **sequence_views(p, days, back),
        f"{p}ok": f"SELECT * FROM {p}seq WHERE frequency >= 3 AND probability >= 0.7",
        f"{p}pat": f"""SELECT a_entity_type AS source_type, a_entity_id AS source_id, b_entity_type AS target_type, b_entity_id AS target_id,
            a_event AS source_event, b_event AS target_event, {LABEL} AS rel_type,
            round(least(CAST(0.40 AS DOUBLE) * probability + CAST(0.35 AS DOUBLE) * (frequency / (SELECT max(frequency) FROM {p}ok))
              + CAST(0.25 AS DOUBLE) * temporal_score, 1.0), 6) AS weight, probability AS confidence, frequency, temporal_score, first_seen, last_seen FROM {p}ok""",
        f"{p}new": f"""SELECT source_type, source_id, target_type, target_id, rel_type, arg_max(struct_pack(w := weight, c := confidence, t := temporal_score, a := source_event, b := target_event),
              struct_pack(w := weight, c := confidence, a := source_event, b := target_event)) AS x, CAST(sum(frequency) AS BIGINT) AS frequency, max(last_seen) AS last_updated
            FROM {p}pat GROUP BY source_type, source_id, target_type, target_id, rel_type""",
    }


def load_events(spark, sf_dir):
    """Weekly deviation events, written once; their number is bounded by entities x weeks."""
    return stored_table(spark, "deviation_events", sf_dir, lambda: P.deviation_events(known_lines(spark, sf_dir, *COLS.split())))


def load_network(spark, sf_dir, every=False):
    """The edges events may follow, written once; five a supplier besides those of the catalogue, or with `every` all partners of a supplier."""
    return stored_table(spark, "entity_network_every" if every else "entity_network", sf_dir, lambda: P.entity_network(known_lines(spark, sf_dir, *COLS.split()), every))


def over_events(name, run, sql, **views):
    register(name, lambda spark, sf_dir: run(load_events(spark, sf_dir)), with_views(sql, **{**BASE, **views}))


def over_network(name, run, sql, **views):
    """Register a query over the events and the network they follow."""
    register(name, lambda spark, sf_dir: run(load_events(spark, sf_dir), load_network(spark, sf_dir)), with_views(sql, **{**BASE, **views}))


over_items("classify_event", lambda d: P.deviation_events(d).select("entity_type", "entity_id", "ts", "event", r(F.col("deviation"), 4).alias("deviation")), COLS,
            "SELECT entity_type, entity_id, ts, event, round(deviation, 4) AS deviation FROM dev", **BASE)


def _deviation_join(d):
    f = P.with_forecast(P.entity_weeks(d))
    j = P.deviation_join(f.drop("actual"), f.drop("predicted"))
    return j.select("entity_type", "entity_id", "ts", r(F.col("predicted"), 4).alias("predicted"), "actual", r(F.col("deviation_pct")).alias("deviation_pct"))


over_items("deviation_join", _deviation_join, COLS,
           "SELECT entity_type, entity_id, ts, round(predicted, 4) AS predicted, actual, round(deviation_pct, 6) AS deviation_pct FROM dev", **BASE)
over_events("window_filter", lambda e: P.window_filter(e, 30).select("entity_type", "entity_id", "ts", "event"),
            f"SELECT entity_type, entity_id, ts, event FROM ({window_sql(30)})")
register("interval_join_lag", lambda spark, sf_dir: P.interval_pairs(load_events(spark, sf_dir), load_network(spark, sf_dir, every=True)),
         with_views(pairs_sql("dev"), **{**BASE, "net": EVERY_LINK}))
# Chains by joining steps with steps, counted per last step and kind of the first event. Events get numbers, so that the joins are on integers.
CHAINS = {
    **BASE, "numbered": "SELECT *, row_number() OVER (ORDER BY entity_type, entity_id, ts) AS id FROM dev", "pairs": pairs_sql("dev"),
    "steps": """SELECT p.*, a.id AS a, b.id AS b, a_entity_type AS ta, b_entity_type AS tb FROM pairs p
        JOIN numbered a ON a.entity_type = a_entity_type AND a.entity_id = a_entity_id AND a.ts = a_ts JOIN numbered b ON b.entity_type = b_entity_type AND b.entity_id = b_entity_id AND b.ts = b_ts""",
    "n2": "SELECT a, b, a_event AS head_event, 1 AS chains FROM steps",
    "n3": "SELECT s2.a, s2.b, s1.a_event AS head_event, count(*) AS chains FROM steps s1 JOIN steps s2 ON s1.b = s2.a WHERE s1.ta <> s2.tb GROUP BY ALL",
    "n4": """SELECT s3.a, s3.b, s1.a_event AS head_event, count(*) AS chains FROM steps s1 JOIN steps s2 ON s1.b = s2.a JOIN steps s3 ON s2.b = s3.a
        WHERE s1.ta <> s2.tb AND s2.ta <> s3.tb AND s1.ta <> s3.tb GROUP BY ALL""",
    **{f"c{n}": f"SELECT s.*, head_event, chains FROM n{n} JOIN steps s USING (a, b)" for n in (2, 3, 4)},
}
STEP = ", ".join(P.STEP)


def chain_rows(e, net):
    """Chains of three and four events by their last step."""
    steps = checkpoint(P.interval_pairs(e, net))
    per = lambda n: P.chain_states(steps, n).groupBy(*P.STEP).agg(F.sum("chains").alias("chains")).withColumn("length", F.lit(n))
    return per(3).unionByName(per(4))


over_network("interval_chain_join", chain_rows,
             " UNION ALL ".join(f"SELECT {STEP}, CAST(sum(chains) AS BIGINT) AS chains, {n} AS length FROM c{n} GROUP BY ALL" for n in (3, 4)), **CHAINS)


def chain_count_sql() -> str:
    parts = []
    for n in (2, 3, 4):
        before = "SELECT entity_type AS a_entity_type, entity_id AS a_entity_id, event AS a_event, event AS head_event, count(*) AS source_total FROM dev GROUP BY ALL" if n == 2 else (
            f"SELECT b_entity_type AS a_entity_type, b_entity_id AS a_entity_id, b_event AS a_event, head_event, CAST(sum(chains) AS BIGINT) AS source_total FROM c{n - 1} GROUP BY ALL")
        parts.append(f"""SELECT * FROM (
          SELECT {n} AS length, head_event, {SEQ}, CAST(sum(chains) AS BIGINT) AS frequency, CAST(sum(chains // ends) AS BIGINT) AS followed, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd,
            date_diff('day', min(a_ts), max(a_ts)) AS span, min(a_ts) AS first_seen, max(a_ts) AS last_seen
          FROM (SELECT *, date_diff('day', lag(a_ts) OVER (PARTITION BY head_event, {SEQ} ORDER BY a_ts), a_ts) AS gap FROM (
            SELECT head_event, {SEQ}, a_ts, CAST(sum(chains) AS BIGINT) AS chains, count(DISTINCT b_ts) AS ends FROM c{n} GROUP BY ALL)) GROUP BY ALL)
          JOIN ({before}) USING (a_entity_type, a_entity_id, a_event, head_event)""")
    return f"""SELECT length, head_event, {SEQ}, frequency, followed, source_total, round(followed / source_total, 6) AS probability,
      round(CASE WHEN n < 2 THEN 0.5 WHEN m = 0 THEN 1.0 ELSE least(1 / (1 + sd / m) + least(span / 60, 0.2), 1.0) END, 6) AS temporal_score, first_seen, last_seen
      FROM ({" UNION ALL BY NAME ".join(parts)})"""


over_network("sequence_count_multi", lambda e, net: P.chain_counts(checkpoint(P.interval_pairs(e, net)), e), chain_count_sql(), **CHAINS)
over_network("sequence_count", lambda e, net: P.sequence_counts(P.window_filter(e, 364), net, window_days=364).drop("temporal_score", "first_seen", "last_seen"),
             f"SELECT {SEQ}, frequency, pair_count, source_total, probability FROM sseq", **sequence_views("s", 364))
over_network("temporal_regularity", lambda e, net: P.sequence_counts(P.window_filter(e, 364), net, window_days=364).select(*P.SEQUENCE, "temporal_score", "first_seen", "last_seen"),
             f"SELECT {SEQ}, temporal_score, first_seen, last_seen FROM sseq", **sequence_views("s", 364))
DAYS = 90
over_network("pattern_gate_score", lambda e, net: P.detect_patterns(e, net, DAYS), "SELECT * FROM npat", **pattern_views("n", DAYS))
over_network(
    "causal_label",
    lambda e, net: P.interval_pairs(P.window_filter(e, DAYS), net).select("a_event", "b_event").distinct().withColumn(
        "rel_type", P.causal_label(F.col("a_event"), F.col("b_event"))),
    f"SELECT DISTINCT a_event, b_event, {LABEL} AS rel_type FROM ({pairs_sql('wev')})", wev=window_sql(DAYS),
)

# Existing edges come from a window that ended 28 days before the latest event, new patterns from the latest window.
OLD = 28
LIFE = {**pattern_views("o", DAYS, OLD), **pattern_views("n", DAYS)}
UPSERT = """
SELECT source_type, source_id, target_type, target_id, rel_type,
  CASE WHEN o.x IS NOT NULL AND n.x IS NOT NULL THEN 'edge_strengthened' WHEN o.x IS NULL THEN 'edge_created' ELSE 'unchanged' END AS action,
  o.x.w AS weight_before,
  CASE WHEN o.x IS NOT NULL AND n.x IS NOT NULL THEN round(least(o.x.w * CAST(0.6 AS DOUBLE) + n.x.w * CAST(0.4 AS DOUBLE), 1.0), 6) ELSE coalesce(o.x.w, n.x.w) END AS weight,
  coalesce(n.x.c, o.x.c) AS confidence, coalesce(n.x.t, o.x.t) AS temporal_score, coalesce(n.x.a, o.x.a) AS source_event, coalesce(n.x.b, o.x.b) AS target_event,
  coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, coalesce(n.last_updated, o.last_updated) AS last_updated,
  CASE WHEN o.x IS NOT NULL AND n.x IS NOT NULL THEN 2 ELSE 1 END AS repetitions, 'CANDIDATE' AS status,
  CASE WHEN coalesce(n.x.c, o.x.c) >= 0.70 THEN 1 ELSE 0 END AS is_stable,
  CASE WHEN o.x IS NOT NULL AND n.x IS NOT NULL THEN 2 ELSE 1 END AS history_len
FROM onew o FULL OUTER JOIN nnew n USING (source_type, source_id, target_type, target_id, rel_type)"""
EDGES = {**LIFE, "ed": UPSERT}


def evolved(e, net):
    old = P.new_edges(P.detect_patterns(e, net, DAYS, OLD))
    return P.upsert_edges(old, P.detect_patterns(e, net, DAYS))


def load_edges(spark, sf_dir):
    return stored_table(spark, "inferred_edges", sf_dir, lambda: evolved(load_events(spark, sf_dir), load_network(spark, sf_dir)))


def over_edges(name, run, sql, **views):
    """Register a query over the inferred edge table and the events behind it."""
    register(name, lambda spark, sf_dir: run(load_edges(spark, sf_dir), load_events(spark, sf_dir)), with_views(sql, **{**BASE, **EDGES, **views}))


KEYS = P.EDGE_KEY
K = ", ".join(KEYS)
over_network("pattern_upsert", lambda e, net: evolved(e, net).withColumn("history_len", F.size("history")).drop("history"), "SELECT * FROM ed", **EDGES)
over_edges(
    "edge_strengthen",
    lambda d, e: d.where("action = 'edge_strengthened'").select(*KEYS, "weight_before", "weight", "frequency", "repetitions", "status"),
    f"SELECT {K}, weight_before, weight, frequency, repetitions, status FROM ed WHERE action = 'edge_strengthened'",
)
over_edges("edge_promote_stable", lambda d, e: d.select(*KEYS, "confidence", "is_stable"), f"SELECT {K}, confidence, is_stable FROM ed")
_DAYS_OLD = "date_diff('day', last_updated, (SELECT max(ts) FROM dev) + 21)"
DECAY = f"""SELECT *, CASE WHEN w < 0.1 THEN 0.0 ELSE w END AS new_weight, CASE WHEN w < 0.1 THEN 'edge_removed' ELSE 'edge_decayed' END AS new_action
  FROM (SELECT *, round(weight * power(CAST(0.95 AS DOUBLE), {_DAYS_OLD}), 6) AS w FROM ed)"""


def decayed(d, e):
    return P.decay_edges(d, F.date_add(e.agg(F.max("ts")).scalar(), 21))


over_edges("edge_decay", lambda d, e: decayed(d, e).select(*KEYS, "weight_before", "weight", "action"),
           f"SELECT {K}, weight AS weight_before, new_weight AS weight, new_action AS action FROM dc", dc=DECAY)
_SEASON = "CAST(((SELECT max(year(ts)) FROM dev) || '-12-15') AS DATE)"
over_edges(
    "edge_decay_seasonal",
    lambda d, e: P.decay_edges(d, F.to_date(F.concat(e.agg(F.max(F.year("ts"))).scalar().cast("string"), F.lit("-12-15")))).select(
        *KEYS, "weight_before", "weight", "action"),
    f"""SELECT {K}, weight AS weight_before, round(greatest(weight * power(CAST(0.975 AS DOUBLE), date_diff('day', last_updated, {_SEASON})), 0.40), 6) AS weight,
        'edge_decayed' AS action FROM ed""",
)
over_edges(
    "mutation_log",
    lambda d, e: d.where("action <> 'unchanged'").select(*KEYS, "action", "weight_before", F.col("weight").alias("weight_after"), "frequency").unionByName(
        decayed(d, e).select(*KEYS, "action", "weight_before", F.col("weight").alias("weight_after"), "frequency")),
    f"""SELECT {K}, action, weight_before, weight AS weight_after, frequency FROM ed WHERE action <> 'unchanged'
        UNION ALL SELECT {K}, new_action, weight, new_weight, frequency FROM dc""", dc=DECAY,
)
over_edges(
    "mutation_summary",
    lambda d, e: d.groupBy("action").agg(F.count(F.lit(1)).alias("n"), r(F.avg("weight")).alias("avg_weight")),
    "SELECT action, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM ed GROUP BY action",
)


def evolution_report(d, e):
    """Per pair of entity types: edges created, strengthened, left as they were and promoted in the cycle, and decayed and removed in the pass after it."""
    types = ["source_type", "target_type"]
    cycle = d.groupBy(*types).agg(
        F.count_if(F.col("action") == "edge_created").alias("created"), F.count_if(F.col("action") == "edge_strengthened").alias("strengthened"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.sum("is_stable").alias("promoted"), r(F.max("weight")).alias("top_weight"))
    later = decayed(d, e).groupBy(*types).agg(F.count_if(F.col("action") == "edge_decayed").alias("decayed"), F.count_if(F.col("action") == "edge_removed").alias("removed"))
    return cycle.join(later, types)


over_edges(
    "evolution_report", evolution_report,
    """SELECT source_type, target_type, count(*) FILTER (action = 'edge_created') AS created, count(*) FILTER (action = 'edge_strengthened') AS strengthened,
       count(*) FILTER (action = 'unchanged') AS unchanged, CAST(sum(is_stable) AS BIGINT) AS promoted, round(max(weight), 6) AS top_weight,
       count(*) FILTER (new_action = 'edge_decayed') AS decayed, count(*) FILTER (new_action = 'edge_removed') AS removed FROM dc GROUP BY source_type, target_type""", dc=DECAY,
)
over_edges(
    "top_patterns", lambda d, e: d.select(*KEYS, "source_event", "target_event", "weight", "confidence", "frequency").orderBy(F.desc("weight"), F.desc("confidence"), *KEYS).limit(10),
    f"SELECT {K}, source_event, target_event, weight, confidence, frequency FROM ed ORDER BY weight DESC, confidence DESC, {K} LIMIT 10",
)
_A = "source_event"
VALID = f"""SELECT *, CASE WHEN source_event NOT IN ('SUPPLIER_DELAY', 'DEMAND_SPIKE', 'INVENTORY_DROP', 'LATE_DELIVERY') THEN 'unknown_source_event'
  WHEN NOT ((source_event = 'SUPPLIER_DELAY' AND target_event IN ('DEMAND_SPIKE', 'INVENTORY_DROP')) OR (source_event = 'DEMAND_SPIKE' AND target_event IN ('SUPPLIER_DELAY', 'INVENTORY_DROP'))
    OR (source_event = 'INVENTORY_DROP' AND target_event IN ('DEMAND_SPIKE', 'SUPPLIER_DELAY')) OR (source_event = 'LATE_DELIVERY' AND target_event = 'CUSTOMER_CHURN')) THEN 'unknown_transition'
  ELSE 'ok' END AS reason FROM ed"""
over_edges("edge_validate", lambda d, e: P.validate_edges(d).select(*KEYS, "source_event", "target_event", "accepted", "reason"),
           f"SELECT {K}, source_event, target_event, CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS accepted, reason FROM v", v=VALID)
_S = "(weight * CAST(0.6 AS DOUBLE) + least(frequency / 50, 1.0) * CAST(0.4 AS DOUBLE))"
IMP = f"CASE WHEN {_S} >= 0.75 THEN 'Critical' WHEN {_S} >= 0.50 THEN 'High' WHEN {_S} >= 0.25 THEN 'Medium' ELSE 'Low' END"
over_edges("edge_importance", lambda d, e: d.select(*KEYS, "weight", "frequency", P.importance().alias("importance")),
           f"SELECT {K}, weight, frequency, {IMP} AS importance FROM ed")
over_edges(
    "edge_summary",
    lambda d, e: d.withColumn("i", P.importance()).agg(
        F.count(F.lit(1)).alias("total_edges"), r(F.avg("weight")).alias("avg_weight"), r(F.avg("confidence")).alias("avg_confidence"),
        r(F.avg("frequency")).alias("avg_occurrences"),
        *[F.count_if(F.col("i") == x).alias(f"{x.lower()}_count") for x in ("Critical", "High", "Medium", "Low")]),
    f"""SELECT count(*) AS total_edges, round(avg(weight), 6) AS avg_weight, round(avg(confidence), 6) AS avg_confidence, round(avg(frequency), 6) AS avg_occurrences,
        count(*) FILTER (i = 'Critical') AS critical_count, count(*) FILTER (i = 'High') AS high_count, count(*) FILTER (i = 'Medium') AS medium_count,
        count(*) FILTER (i = 'Low') AS low_count FROM (SELECT *, {IMP} AS i FROM ed)""",
)
over_edges("top_edges", lambda d, e: d.select(*KEYS, "weight", "confidence", "frequency", P.importance().alias("importance")).orderBy(F.desc("weight"), *KEYS).limit(100),
           f"SELECT {K}, weight, confidence, frequency, {IMP} AS importance FROM ed ORDER BY weight DESC, {K} LIMIT 100")


def insight_severity(d, e):
    s = d.select(*KEYS, "weight", F.when(F.col("weight") > 0.8, "Critical").when(F.col("weight") > 0.6, "Warning").otherwise("Info").alias("severity"))
    score = s.agg(F.greatest(F.lit(0), 100 - F.count_if(F.col("severity") == "Critical") * 15 - F.count_if(F.col("severity") == "Warning") * 5)).scalar()
    return s.withColumn("health_score", score.cast("long"))


over_edges(
    "insight_severity", insight_severity,
    f"""SELECT {K}, weight, s AS severity, (SELECT greatest(0, 100 - count(*) FILTER (weight > 0.8) * 15 - count(*) FILTER (weight > 0.6 AND weight <= 0.8) * 5) FROM ed) AS health_score
        FROM (SELECT *, CASE WHEN weight > 0.8 THEN 'Critical' WHEN weight > 0.6 THEN 'Warning' ELSE 'Info' END AS s FROM ed)""",
)


def _verdicts(e):
    """An entity confirms its edges when its latest deviation went up, and rejects them otherwise."""
    return e.groupBy(F.col("entity_type").alias("target_type"), F.col("entity_id").alias("target_id")).agg(
        (F.max_by("deviation", "ts") > 0).cast("int").alias("correct"))


VERDICT = "SELECT entity_type AS target_type, entity_id AS target_id, CASE WHEN arg_max(deviation, ts) > 0 THEN 1 ELSE 0 END AS correct FROM dev GROUP BY ALL"
over_edges(
    "feedback_adjust",
    lambda d, e: P.feedback_adjust(d, _verdicts(e), ["target_type", "target_id"]).select(*KEYS, "confidence", "new_confidence", "new_status"),
    f"""SELECT {K}, confidence, round(nc, 6) AS new_confidence, CASE WHEN nc < 0.5 THEN 'CANDIDATE' ELSE 'ACTIVE' END AS new_status
        FROM (SELECT *, greatest(least(confidence + CASE WHEN correct = 1 THEN CAST(0.10 AS DOUBLE) ELSE CAST(-0.20 AS DOUBLE) END, 1.0), 0.0) AS nc
              FROM ed JOIN vd USING (target_type, target_id))""", vd=VERDICT,
)
over_edges(
    "feedback_summary",
    lambda d, e: d.join(_verdicts(e), ["target_type", "target_id"]).groupBy("target_type").agg(
        F.count(F.lit(1)).alias("total"), F.sum("correct").alias("correct"), F.sum(1 - F.col("correct")).alias("incorrect"),
        r(ratio(F.sum("correct"), F.count(F.lit(1))) * 100).alias("accuracy_pct")),
    """SELECT target_type, count(*) AS total, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(1 - correct) AS BIGINT) AS incorrect,
       round(sum(correct) / count(*) * 100, 6) AS accuracy_pct FROM ed JOIN vd USING (target_type, target_id) GROUP BY target_type""", vd=VERDICT,
)


def edge_density(d, e, days=30):
    """Inferred edges touching each entity in the trailing days, over the largest such count."""
    recent = d.where(F.col("last_updated") >= F.date_sub(e.agg(F.max("ts")).scalar(), days))
    ends = recent.select(F.explode(F.array(F.struct(F.col("source_type").alias("t"), F.col("source_id").alias("i")),
                                           F.struct(F.col("target_type").alias("t"), F.col("target_id").alias("i")))).alias("n"))
    g = ends.groupBy(F.col("n.t").alias("entity_type"), F.col("n.i").alias("entity_id")).agg(F.count(F.lit(1)).alias("edge_count"))
    return g.withColumn("density", r(F.col("edge_count") / g.agg(F.max("edge_count")).scalar()))


over_edges(
    "edge_density_30d", edge_density,
    """, rc AS (SELECT * FROM ed WHERE last_updated >= (SELECT max(ts) FROM dev) - 30),
       g AS (SELECT entity_type, entity_id, count(*) AS edge_count FROM (SELECT source_type AS entity_type, source_id AS entity_id FROM rc
             UNION ALL SELECT target_type, target_id FROM rc) GROUP BY ALL)
       SELECT *, round(edge_count / (SELECT max(edge_count) FROM g), 6) AS density FROM g""",
)


def patterns_from_contributors(d):
    """Root-cause contributors (entities with their late share) as pattern rows pointing at late delivery."""
    g = d.groupBy("ship_mode", "city").agg(F.avg("late").alias("s"), F.sum("late").alias("f"))
    return g.where("s >= 0.5").select(
        F.concat_ws("|", "ship_mode", "city").alias("source_id"), F.lit("Supplier").alias("source_type"), F.lit("late_delivery").alias("target_id"),
        F.lit("Shipment").alias("target_type"), F.lit("RCA_CAUSAL_CASCADE").alias("rel_type"), r(F.col("s")).alias("weight"),
        F.col("f").alias("frequency"), r(F.col("s") * 0.9, 8).alias("probability"), F.lit(30).alias("window_days"))


over_items(
    "patterns_from_contributors", patterns_from_contributors, "ship_mode city late",
    """SELECT ship_mode || '|' || city AS source_id, 'Supplier' AS source_type, 'late_delivery' AS target_id, 'Shipment' AS target_type,
       'RCA_CAUSAL_CASCADE' AS rel_type, round(avg(late), 6) AS weight, CAST(sum(late) AS BIGINT) AS frequency, round(avg(late) * CAST(0.9 AS DOUBLE), 8) AS probability,
       30 AS window_days FROM oi GROUP BY ship_mode, city HAVING avg(late) >= 0.5""",
)
