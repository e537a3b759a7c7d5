import datetime

from pyspark.sql import functions as F

from freightloom.session import work_path
from freightloom.streaming import jobs as J


def as_stream(df, files=4):
    path = work_path(df.sparkSession, "stream-test")
    df.repartition(files).write.parquet(path)
    return J.stream_table(df.sparkSession, path, df.schema, files_per_trigger=1)


def deliver(df, folder, name):
    df.write.parquet(f"{folder}/{name}")


def test_ingest_keeps_a_period_once(spark):
    """A replayed period and a replayed batch leave store and manifest as they were; other rows under an old period are told apart."""
    landing, target, marks = (work_path(spark, n) for n in ("ingest-in", "ingest-out", "ingest-marks"))
    df = spark.range(100).select("id", F.concat(F.lit("2024-0"), (F.col("id") % 3 + 1).cast("string")).alias("period"))
    run = lambda mark: J.ingest_increments(J.stream_table(spark, f"{landing}/*", df.schema), target, checkpoint=f"{marks}/{mark}")
    deliver(df, landing, "a")
    store, _ = run("one")
    assert sorted(r.id for r in store.collect()) == list(range(100))
    deliver(df.where("period = '2024-01'"), landing, "b")
    deliver(df.where("period = '2024-02'").withColumn("id", F.col("id") + 1), landing, "c")
    deliver(spark.createDataFrame([(500, "2024-04")], df.schema), landing, "d")
    store, manifest = run("one")
    assert sorted(r.id for r in store.collect()) == [*range(100), 500]
    status = {(r.period, r.delivery.rsplit("/", 1)[1]): r.status for r in manifest.collect()}
    assert status == {("2024-01", "a"): "accepted", ("2024-02", "a"): "accepted", ("2024-03", "a"): "accepted", ("2024-01", "b"): "replayed",
                      ("2024-02", "c"): "conflict", ("2024-04", "d"): "accepted"}
    store, manifest = run("two")  # the stream's memory is lost: everything comes once more as one batch
    assert sorted(r.id for r in store.collect()) == [*range(100), 500] and manifest.where("status = 'accepted'").count() == 4


def in_parts(spark, parts, schema):
    path = work_path(spark, "stream-parts")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={k}")
    return path


def life(hits, newest):
    """The log of one edge from the rules: hits by day, passes 30 days after the last change, up to a day."""
    import datetime as dt

    def left(w, a, b):
        season = (dt.date(1970, 1, 1) + dt.timedelta(days=b)).month in (11, 12)
        rest = w * (0.975 if season else 0.95) ** (b - a)
        return max(rest, 0.4) if season else rest

    log, state = [], None
    for day, n in [*hits, (None, 0)]:
        while state and state[1] + 30 < (newest if day is None else day):
            w, last, total = state
            rest = left(w, last, last + 30)
            log.append((last + 30, "edge_removed" if rest < 0.1 else "edge_decayed", round(rest if rest >= 0.1 else 0.0, 9), total))
            state = None if rest < 0.1 else (rest, last + 30, total)
        if day is None:
            break
        if state is None:
            state = (0.4, day, n)
            log.append((day, "edge_created", 0.4, n))
        elif day <= state[1]:
            log.append((day, "late", round(state[0], 9), state[2]))
        else:
            state = (min(left(state[0], state[1], day) * 0.6 + 0.4, 1.0), day, state[2] + n)
            log.append((day, "edge_strengthened", round(state[0], 9), state[2]))
    return log


def test_edge_life_over_batches(spark):
    """Decay without hits, removal, half rate and floor in the season, and late days, whatever batch the hits come in."""
    start = (datetime.date(2024, 8, 1) - datetime.date(1970, 1, 1)).days
    at = lambda d: datetime.datetime(1970, 1, 1) + datetime.timedelta(days=start + d)
    a = [(0, 2), (7, 1), (14, 1), (120, 3)]  # dies in autumn, comes back in November
    b = [(0, 1), (85, 1), (92, 2), (99, 1)]  # into the season, where it stays at the floor
    rows = [[("a", at(d), start + d, n) for d, n in a[:3]] + [("b", at(0), start, 1)], [("b", at(d), start + d, n) for d, n in b[1:]], [("a", at(120), start + 120, 3), ("b", at(118), start + 118, 1)],
            [("b", at(117), start + 117, 4), ("z", at(300), start + 300, 1)]]
    path = in_parts(spark, rows, "edge string, ts timestamp, day long, n long")
    stream = J.stream_table(spark, f"{path}/*", spark.read.parquet(f"{path}/*").schema, files_per_trigger=1)
    got = J.run_to_table(J.edge_life(stream, "5 days"), "edge-life-test").collect()
    newest = start + 295
    for edge, hits in (("a", a), ("b", [*b, (118, 1), (117, 4)])):
        mine = sorted((r.day, r.action, round(r.weight, 9), r.hits) for r in got if r.edge == edge)
        assert mine == sorted(life([(start + d, n) for d, n in hits], newest)), edge
    actions = {r.action for r in got}
    assert actions == {"edge_created", "edge_strengthened", "edge_decayed", "edge_removed", "late"}
    assert any(r.edge == "b" and r.action == "edge_decayed" and r.weight == 0.4 for r in got)


def test_dedup_drops_repeats(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 5, t) for i in range(20)], "k long, ts timestamp")
    got = J.run_to_table(J.dedup(as_stream(df, 1), ["k"], "ts", "1 hour"), "dedup-test")
    assert sorted(r.k for r in got.collect()) == list(range(5))


def test_sequence_join_keeps_an_event_once_an_edge(spark):
    """Both orders of linked events are found over parts by time, and an event many suppliers are linked with is not kept once for each."""
    schema, suppliers = "entity_type string, entity_id string, event string, ts timestamp", 200
    week = lambda w: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=7 * w)
    parts = [[*[("Supplier", f"s{k}", "A", week(w)) for k in range(suppliers) for w in ws], *[("Order", "all", "B", week(w)) for w in ws]] for ws in ((0, 1, 2), (3, 4, 5))]
    network = spark.createDataFrame([("Supplier", f"s{k}", "Order", "all") for k in range(suppliers)], "x_type string, x_id string, y_type string, y_id string")
    arriving = lambda: J.stream_table(spark, f"{path}/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    path = in_parts(spark, parts, schema)
    writer = J.sequence_join(arriving(), arriving(), network).writeStream.format("memory").queryName("sequences").option(
        "checkpointLocation", work_path(spark, "sequences")).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    got = {(r.a_event, r.b_event): r.n for r in spark.table("sequences").groupBy("a_event", "b_event").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("A", "B"): 5 * suppliers, ("B", "A"): 5 * suppliers}
    assert spark.table("sequences").where("a_ts >= b_ts OR (a_event = 'A') <> (a_entity <> 'all')").count() == 0
    kept = sum(o.numRowsUpdated for p in query.recentProgress for o in p.stateOperators)
    assert 6 * suppliers <= kept < 2 * 6 * suppliers
