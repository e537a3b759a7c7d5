"""Streaming queries; each is checked against the SQL of its batch twin where it has one."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from freightloom.operators import patterns as P
from freightloom.operators.analytics import r
from freightloom.plans.evaluate import MEMORY, _MC, agent_memory
from freightloom.plans.patterns import BASE, COLS, LABEL, load_events, load_network, pairs_sql
from freightloom.plans.registry import query, register, with_views
from freightloom.plans.views import CELLS
from freightloom.session import work_path, written
from freightloom.sources import order_items
from freightloom.streaming import jobs as J


def landed(df, name, partitions=4):
    """Write a table as the files a stream will find."""
    path = work_path(df.sparkSession, f"landing-{name}")
    df.repartition(partitions).write.parquet(path)
    return path


def landed_in_order(df, name, ts, parts=4):
    """Write a table as the files a stream will find, one part after the other by time, each with files of its own."""
    path, df = work_path(df.sparkSession, f"landing-{name}"), written(df, f"unordered-{name}")
    days = df.agg(F.struct(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))).scalar()
    width = F.datediff(days["hi"], days["lo"]) + 1
    # A part is read from files of its own, so the table is read once and not for every part.
    placed = work_path(df.sparkSession, f"parts-{name}")
    df.withColumn("_part", F.floor(F.datediff(F.to_date(ts), days["lo"]) * parts / width).cast("int")).write.partitionBy("_part").parquet(placed)
    for k in range(parts):
        df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(placed).where(F.col("_part") == k).drop("_part").coalesce(1).write.parquet(f"{path}/part={k}")
    return path


def ingested(spark, sf_dir):
    """All months arrive; then the first three arrive again, and the last with other rows. The same stream goes on over both deliveries."""
    d = order_items(spark, sf_dir, "period", "order_id", "line_no", "sales")
    landing, target, checkpoint = (work_path(spark, n) for n in ("landing-months", "ingested", "ingest-checkpoint"))
    run = lambda: J.ingest_increments(J.stream_table(spark, f"{landing}/*", d.schema), target, checkpoint=f"{checkpoint}/stream")
    d.write.parquet(f"{landing}/first")
    run()
    months = d.select("period").distinct()
    old, new = months.orderBy("period").limit(3), months.orderBy(F.desc("period")).limit(1)
    again = d.join(old, "period", "left_semi").unionByName(d.join(new, "period", "left_semi").withColumn("sales", F.col("sales") + 1))
    again.write.parquet(f"{landing}/second")
    return run()


@query("stream_ingest_increments", sql=with_views("SELECT period, count(*) AS n_rows, round(sum(sales), 2) AS sales FROM oi GROUP BY period"))
def stream_ingest_increments(spark, sf_dir):
    """What was delivered twice is stored once."""
    got, _ = ingested(spark, sf_dir)
    return got.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("sales"), 2).alias("sales"))


@query("stream_ingest_manifest", sql=with_views(
    """SELECT period, 'first' AS delivery, 'accepted' AS status, count(*) AS n_rows FROM oi GROUP BY period
       UNION ALL SELECT period, 'second', CASE WHEN period = (SELECT max(period) FROM oi) THEN 'conflict' ELSE 'replayed' END, count(*) FROM oi
         WHERE period IN (SELECT DISTINCT period FROM oi ORDER BY period LIMIT 3) OR period = (SELECT max(period) FROM oi) GROUP BY period"""))
def stream_ingest_manifest(spark, sf_dir):
    """What became of each delivery of each month."""
    _, manifest = ingested(spark, sf_dir)
    return manifest.select("period", F.element_at(F.split("delivery", "/"), -1).alias("delivery"), "status", "n_rows")


@query("stream_dedup", sql="SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    """Every event sent twice arrives once."""
    twice = J.event_stream(spark, sf_dir).unionByName(J.event_stream(spark, sf_dir)).select("event_id", "event_type", "ts")
    got = J.run_to_table(J.dedup(twice, ["event_id"], "ts", "2 days"), "dedup")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "epoch(ts)::BIGINT // 604800 * 604800"


@query("stream_tumbling_kpis", sql="""
SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT *, CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800 AS w FROM events)
WHERE w + 604800 <= (SELECT epoch(max(ts)) - 86400 FROM events) GROUP BY w, event_type""")
def stream_tumbling_kpis(spark, sf_dir):
    return J.run_to_table(J.windowed_kpis(J.event_stream(spark, sf_dir), "ts", "1 day", "7 days"), "tumbling")


@query("stream_sliding_window", sql="""
SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT *, unnest(range(30)) AS k FROM events), LATERAL (SELECT (CAST(floor(epoch(ts) / 86400) AS BIGINT) - k) * 86400 AS w)
WHERE w + 30 * 86400 <= (SELECT epoch(max(ts)) - 86400 FROM events) GROUP BY w, event_type""")
def stream_sliding_window(spark, sf_dir):
    return J.run_to_table(J.windowed_kpis(J.event_stream(spark, sf_dir), "ts", "1 day", "30 days", "1 day"), "sliding")


@query("stream_sessions", sql="""
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM (
  SELECT user_id, s, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS until FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)
WHERE until <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY user_id""")
def stream_sessions(spark, sf_dir):
    got = J.run_to_table(J.session_kpis(J.event_stream(spark, sf_dir), "ts", "1 day", "6 hours"), "sessions")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def stream_deviation_join(spark, sf_dir):
    weeks = P.with_forecast(P.entity_weeks(order_items(spark, sf_dir, *COLS.split()))).withColumn("ts", F.col("ts").cast("timestamp"))
    f = weeks.where("predicted IS NOT NULL").select("entity_type", "entity_id", "ts", "predicted")
    a = weeks.select("entity_type", "entity_id", "ts", "actual")
    joined = J.deviation_join(J.stream_table(spark, landed(f, "forecasts"), f.schema), J.stream_table(spark, landed(a, "actuals"), a.schema))
    got = J.run_to_table(joined, "deviations")
    return got.select("entity_type", "entity_id", F.to_date("ts").alias("ts"), r(F.col("predicted"), 4).alias("predicted"), "actual", F.col("pct").alias("deviation_pct"))


register("stream_deviation_join", stream_deviation_join,
         with_views("SELECT entity_type, entity_id, ts, round(predicted, 4) AS predicted, actual, round(deviation_pct, 6) AS deviation_pct FROM dev", **BASE))


EVENTS_A_PART = 500_000


def stream_sequence_join(spark, sf_dir):
    e = load_events(spark, sf_dir).select("entity_type", "entity_id", "event", F.col("ts").cast("timestamp").alias("ts"))
    # Events arrive by time, so the watermark moves with the batches and the state holds the events of the last weeks only.
    path = f"{landed_in_order(e, 'events', 'ts', max(4, -(-e.count() // EVENTS_A_PART)))}/*"
    arriving = lambda: J.stream_table(spark, path, e.schema, files_per_trigger=1)
    dealers = spark.sparkContext.defaultParallelism  # a part is one file, its events are dealt by many tasks
    got = J.run_to_table(J.sequence_join(arriving().repartition(dealers), arriving(), load_network(spark, sf_dir)), "sequences")
    return got.groupBy("a_event", "b_event", "a_entity", "b_entity").agg(F.count(F.lit(1)).alias("n"))


register("stream_sequence_join", stream_sequence_join, with_views(
    f"SELECT a_event, b_event, a_entity_id AS a_entity, b_entity_id AS b_entity, count(*) AS n FROM ({pairs_sql('dev')}) GROUP BY ALL", **BASE))

_NAMED = " OR ".join(f"(a_event = '{a}' AND b_event = '{b}')" for a, b in P.CAUSAL_NAMES)
EDGE_HITS = f"""SELECT a_entity_id || '>' || {LABEL} || '>' || b_entity_id AS edge, date_diff('day', DATE '1970-01-01', a_ts) AS day, count(*) AS n
  FROM ({pairs_sql('dev')}) WHERE {_NAMED} GROUP BY ALL"""
DELAY_DAYS = 14
_LEFT = """CASE WHEN month(DATE '1970-01-01' + CAST(to_day AS INTEGER)) IN (11, 12) THEN greatest(weight * power(CAST(0.975 AS DOUBLE), to_day - s.day), CAST(0.40 AS DOUBLE))
  ELSE weight * power(CAST(0.95 AS DOUBLE), to_day - s.day) END"""
EDGE_LIFE = f"""
WITH RECURSIVE hits AS (SELECT *, lead(day) OVER (PARTITION BY edge ORDER BY day) AS nxt FROM edge_hits),
last_day AS (SELECT max(day) - {DELAY_DAYS} AS wm FROM edge_hits),
life AS (
  SELECT edge, CAST(day AS BIGINT) AS day, 'edge_created' AS action, CAST(NULL AS DOUBLE) AS weight_before, CAST(0.4 AS DOUBLE) AS weight, CAST(n AS BIGINT) AS hits, CAST(nxt AS BIGINT) AS nxt
  FROM hits QUALIFY row_number() OVER (PARTITION BY edge ORDER BY day) = 1
  UNION ALL
  SELECT edge, to_day, CASE WHEN hit AND gone THEN 'edge_created' WHEN hit THEN 'edge_strengthened' WHEN rest < 0.1 THEN 'edge_removed' ELSE 'edge_decayed' END,
    CASE WHEN hit AND gone THEN NULL ELSE weight END,
    CASE WHEN hit AND gone THEN 0.4 WHEN hit THEN least(rest * (CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE)) + CAST(0.4 AS DOUBLE), 1.0) WHEN rest < 0.1 THEN 0.0 ELSE rest END,
    CASE WHEN hit AND gone THEN n WHEN hit THEN hits + n ELSE hits END, CASE WHEN hit THEN after ELSE nxt END
  FROM (
    SELECT s.*, {_LEFT} AS rest, h.n, h.nxt AS after FROM (
      SELECT *, action = 'edge_removed' AS gone, nxt IS NOT NULL AND (action = 'edge_removed' OR nxt <= day + 30) AS hit,
        CAST(CASE WHEN nxt IS NOT NULL AND (action = 'edge_removed' OR nxt <= day + 30) THEN nxt ELSE day + 30 END AS BIGINT) AS to_day FROM life) s
    LEFT JOIN hits h ON h.edge = s.edge AND h.day = s.to_day AND s.hit)
  WHERE hit OR (NOT gone AND to_day < (SELECT wm FROM last_day)) OR (NOT gone AND nxt IS NOT NULL))
SELECT edge, day, action, round(weight_before, 4) AS weight_before, round(weight, 4) AS weight, hits FROM life"""


def edge_log(spark, sf_dir, parts=4):
    """The life of the causal edges over batches of hits that arrive by time."""
    steps = P.interval_pairs(load_events(spark, sf_dir), load_network(spark, sf_dir))
    a, b = F.col("a_event"), F.col("b_event")
    named = steps.where(F.concat_ws("|", a, b).isin(*["|".join(k) for k in P.CAUSAL_NAMES]))
    edge = F.concat_ws(">", "a_entity_id", P.causal_label(a, b), "b_entity_id").alias("edge")
    day = F.datediff("a_ts", F.lit("1970-01-01").cast("date")).cast("long").alias("day")
    hits = named.groupBy(edge, day, F.col("a_ts").cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    stream = J.stream_table(spark, f"{landed_in_order(hits, 'hits', 'ts', parts)}/*", hits.schema, files_per_trigger=1)
    return J.run_to_table(J.edge_life(stream, f"{DELAY_DAYS} days"), "edge-life")


def stream_edge_state(spark, sf_dir):
    return edge_log(spark, sf_dir).select("edge", "day", "action", r(F.col("weight_before"), 4).alias("weight_before"), r(F.col("weight"), 4).alias("weight"), "hits")


register("stream_edge_state", stream_edge_state, with_views(f"SELECT * FROM ({EDGE_LIFE})", **BASE, edge_hits=EDGE_HITS))


def stream_memory_accuracy(spark, sf_dir):
    m = agent_memory(order_items(spark, sf_dir, *_MC.split())).withColumn("ts", F.to_timestamp(F.concat("period", F.lit("-01"))))
    p, a = m.select("record_id", "agent", "ts", "prediction"), m.select("record_id", "ts", "actual")
    got = J.run_to_table(J.memory_accuracy(J.stream_table(spark, landed(p, "predictions"), p.schema), J.stream_table(spark, landed(a, "outcomes"), a.schema)), "accuracy")
    return got.where("actual IS NOT NULL").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), r(F.avg("accuracy")).alias("mean_accuracy"))


register("stream_memory_accuracy", stream_memory_accuracy,
         with_views("SELECT agent, count(*) AS n, round(avg(accuracy), 6) AS mean_accuracy FROM memory GROUP BY agent", cells=CELLS, memory=MEMORY))


def late_data_side_table(spark, sf_dir):
    """Months arriving out of order: one not later than a month accepted before goes to the side table with a reason."""
    d = order_items(spark, sf_dir, "period", "order_id")
    months = d.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("arrival", F.md5(F.col("period").cast("binary")))
    target = work_path(spark, "arrivals")

    def handle(batch, batch_id):
        # manifest rows only, one per month; the months accepted so far come from the batches written before
        before = spark.read.parquet(target).where(F.col("batch") < batch_id) if batch_id else None
        seen = before.agg(F.max("period")).scalar() if before is not None else F.lit(None).cast("string")
        top = F.max("period").over(Window.partitionBy(F.lit(1)).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
        known = F.greatest(top, seen)
        late = F.coalesce(F.col("period") <= known, F.lit(False))
        batch.select("period", "n_rows", "arrival", F.when(late, "out_of_order").otherwise("accepted").alias("status")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    J.run_batches(J.stream_table(spark, landed(months, "manifests", 1), months.schema), "arrivals", handle)
    return spark.read.parquet(target).select("period", "n_rows", "status")


register("late_data_side_table", late_data_side_table, with_views(
    """SELECT period, n_rows, CASE WHEN period <= max(period) OVER (ORDER BY md5(period) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'out_of_order' ELSE 'accepted' END AS status
       FROM (SELECT period, count(*) AS n_rows FROM oi GROUP BY period)"""))
