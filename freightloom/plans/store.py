"""Sources, sinks and the monthly store."""

from pyspark.sql import functions as F

from freightloom.operators import graph_build as B
from freightloom.operators import graph_walk as G
from freightloom.operators.analytics import monthly_trend, r
from freightloom.plans.evaluate import MEMORY, _MC, agent_memory
from freightloom.plans.graph_build import graph_query
from freightloom.plans.joins import upsert
from freightloom.plans.registry import over_items, query, register, with_views
from freightloom.plans.views import CELLS
from freightloom.session import work_path
from freightloom.sources import order_items, table
from freightloom.sources.store import CumulativeStore, manifest_of, with_digests

CUT = "2001-02"
_STORE = ["period", "order_date", "order_id", "line_no", "product_id", "qty", "sales"]
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("scan_csv_encodings", sql="""SELECT lang, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, 'ISO-8859-1' AS encoding FROM documents GROUP BY lang""")
def scan_csv_encodings(spark, sf_dir):
    """Texts written in Latin-1 and read back in the first encoding that leaves no replacement character."""
    path = work_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", "[\\r\\n]", " ").alias("text"))
    docs.write.options(**CSV, encoding="ISO-8859-1").csv(path)
    for encoding in ("UTF-8", "ISO-8859-1"):
        df = spark.read.schema("doc_id bigint, lang string, text string, _bad string").options(
            **CSV, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").csv(path)
        if encoding == "ISO-8859-1" or df.where(F.contains("text", F.lit("�"))).isEmpty():
            return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.lit(encoding).alias("encoding"))
    raise AssertionError("unreachable")


def _manifest_json(d):
    """A manifest document per year holding an array of months, written as JSON and exploded back."""
    path = work_path(d.sparkSession, "manifest")
    m = d.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("late"), 6).alias("late_rate"))
    docs = m.groupBy(F.substring("period", 1, 4).alias("year")).agg(F.collect_list(F.struct("period", "n_rows", "late_rate")).alias("months"))
    docs.write.json(path)
    back = d.sparkSession.read.schema("year string, months array<struct<period:string,n_rows:bigint,late_rate:double>>").json(path)
    return back.select("year", F.inline("months"))


over_items("scan_json_metadata", _manifest_json, "period late",
           "SELECT substr(period, 1, 4) AS year, period, count(*) AS n_rows, round(avg(late), 6) AS late_rate FROM oi GROUP BY period")


@query("scan_parquet_pruned", sql="SELECT CAST(max(o_orderdate) AS DATE) AS data_end FROM orders")
def scan_parquet_pruned(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).alias("data_end"))


def filled_store(spark, sf_dir, replay=False):
    """A store with the rows before the cut as base and the later months as increments."""
    d = order_items(spark, sf_dir, *_STORE)
    store = CumulativeStore(spark, work_path(spark, "store"))
    store.write_base(d.where(F.col("period") < CUT))
    store.append(d.where((F.col("period") >= CUT) & (F.col("period") < "2001-05")))
    store.append(d.where(F.col("period") >= ("2001-03" if replay else "2001-05")))
    return store


def counts(df):
    return df.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("sales"), 2).alias("sales"))


register("scan_cumulative", lambda spark, sf_dir: counts(filled_store(spark, sf_dir).read()),
         with_views("SELECT period, count(*) AS n_rows, round(sum(sales), 2) AS sales FROM oi GROUP BY period"))
_MAN = "SELECT period, count(*) AS n_rows, max(order_date) AS data_end FROM oi WHERE period >= '2001-02' {} GROUP BY period"
register("sink_increment", lambda spark, sf_dir: filled_store(spark, sf_dir, replay=True).manifest().drop("checksum"), with_views(_MAN.format("")))


def _rolled_back(spark, sf_dir):
    store = filled_store(spark, sf_dir)
    store.rollback("2001-06")
    return store.manifest().drop("checksum")


register("rollback_increment", _rolled_back, with_views(_MAN.format("AND period <> '2001-06'")))


def manifest_summary(d):
    """Periods, rows, data end and whether the checksum agrees with one taken from another row order."""
    columns = ["order_id", "line_no", "product_id", "qty", "sales"]
    a, b = manifest_of(d, columns), manifest_of(d.orderBy(F.desc("order_id")), columns)
    return a.join(b.select("period", F.col("checksum").alias("again")), "period").select(
        "period", "n_rows", "data_end", (F.col("checksum") == F.col("again")).cast("int").alias("checksum_stable"))


over_items("manifest_summary", manifest_summary, " ".join(_STORE), "SELECT period, count(*) AS n_rows, max(order_date) AS data_end, 1 AS checksum_stable FROM oi GROUP BY period")


@query("file_checksum", sql="SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1")
def file_checksum(spark, sf_dir):
    """Uploads by the digest of their content, with copies counted and the first one kept."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept"))


def uploads(spark, sf_dir, names):
    """Rows, columns, size and SHA-256 of each file of the named tables."""
    out = None
    for name in names:
        df = table(spark, sf_dir, name)
        g = df.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.max("_metadata.file_size").alias("file_size"))
        out = g if out is None else out.unionByName(g)
    return with_digests(out)


@query("upload_metadata", sql="""SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows, 11 AS n_columns, 1 AS has_size, 64 AS hash_digits, 1 AS copies FROM lineitem
UNION ALL SELECT 'orders.parquet', count(*), 6, 1, 64, 1 FROM orders UNION ALL SELECT 'documents.parquet', count(*), 5, 1, 64, 1 FROM documents""")
def upload_metadata(spark, sf_dir):
    """The uploads as described, whether each has a size and a whole hash, and how many uploads have its content."""
    found = uploads(spark, sf_dir, ("lineitem", "orders", "documents"))
    copies = found.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(copies, "sha256").select(
        "file_name", "n_rows", "n_columns", (F.col("file_size") > 0).cast("int").alias("has_size"), F.length(F.regexp_extract("sha256", "^[0-9a-f]+$", 0)).alias("hash_digits"), "copies")


def _exports(d):
    """The monthly table written as CSV, TSV and JSON lines and read back with its schema."""
    spark, m = d.sparkSession, monthly_trend(d)
    path, out = work_path(spark, "export"), None
    for fmt, opts in (("csv", {"header": True}), ("tsv", {"header": True, "sep": "\t"}), ("json", {})):
        kind = "json" if fmt == "json" else "csv"
        m.write.format(kind).options(**opts).save(f"{path}/{fmt}")
        back = spark.read.schema(m.schema).format(kind).options(**opts).load(f"{path}/{fmt}").withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


over_items(
    "sink_csv", _exports, "period late days_real days_sched sales qty",
    """SELECT m.*, format FROM (SELECT period, count(*) AS orders, CAST(sum(late) AS BIGINT) AS late_orders, round(avg(late), 6) AS late_rate, round(avg(days_real - days_sched), 6) AS avg_delay,
       round(sum(sales), 2) AS total_sales, CAST(sum(qty) AS BIGINT) AS total_qty FROM oi GROUP BY period) m, (VALUES ('csv'), ('tsv'), ('json')) f(format)""",
)


def _jsonl(d):
    """Prediction records appended as JSON lines agent by agent, then read as one source."""
    m, path = agent_memory(d).select("record_id", "agent", r(F.col("accuracy")).alias("accuracy")), work_path(d.sparkSession, "memory")
    for agent in ("demand", "supplier", "inventory", "logistics"):
        m.where(F.col("agent") == agent).write.mode("append").json(path)
    return d.sparkSession.read.schema(m.schema).json(path)


over_items("sink_jsonl_append", _jsonl, _MC, "SELECT record_id, agent, round(accuracy, 6) AS accuracy FROM memory", cells=CELLS, memory=MEMORY)


def graph_export(n, e):
    """Dump nodes and edges by label and type, reload them and count what came back."""
    spark, path = n.sparkSession, work_path(n.sparkSession, "dump")
    n.write.partitionBy("label").parquet(f"{path}/nodes")
    e.write.partitionBy("rel_type").parquet(f"{path}/edges")
    a = spark.read.parquet(f"{path}/nodes").groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(spark.read.parquet(f"{path}/edges").groupBy(F.col("rel_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


graph_query("graph_export", graph_export, "SELECT label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT rel_type, count(*) FROM edges GROUP BY rel_type")


def graph_import(n, e):
    """Reload a dump and merge it into the node table: known nodes are updated, none is doubled."""
    spark, path = n.sparkSession, work_path(n.sparkSession, "import")
    n.where("label <> 'Order'").withColumn("risk", F.col("risk") + 1).write.parquet(path)
    return upsert(n, spark.read.parquet(path), "node_id").groupBy("label", "state").agg(F.count(F.lit(1)).alias("n"), r(F.sum("risk"), 4).alias("risk"))


graph_query("graph_import", graph_import, """SELECT label, CASE WHEN label = 'Order' THEN 'kept' ELSE 'updated' END AS state, count(*) AS n,
  round(sum(risk + CASE WHEN label = 'Order' THEN 0 ELSE 1 END), 4) AS risk FROM nodes GROUP BY label""")


def snapshot_version(n, e):
    """Three snapshots under version numbers; version 3 is activated, then rolled back to 2."""
    spark, path = n.sparkSession, work_path(n.sparkSession, "versions")
    steps = (e.where("rel_type IN ('SUPPLIES', 'CONTAINS')"), e.where("rel_type <> 'INFLUENCES'"), e)
    for v, part in enumerate(steps, 1):
        part.write.parquet(f"{path}/edges/version={v}")
        spark.range(1).select(F.lit(v).alias("version"), F.lit(v).alias("activated_at")).write.mode("append").parquet(f"{path}/log")
    spark.range(1).select(F.lit(2).alias("version"), F.lit(4).alias("activated_at")).write.mode("append").parquet(f"{path}/log")
    active = spark.read.parquet(f"{path}/log").agg(F.max_by("version", "activated_at")).scalar()
    g = spark.read.parquet(f"{path}/edges").groupBy("version").agg(F.count(F.lit(1)).alias("n_edges"))
    return g.withColumn("is_active", (F.col("version") == active).cast("int"))


graph_query(
    "snapshot_version", snapshot_version,
    """SELECT 1 AS version, count(*) AS n_edges, 0 AS is_active FROM edges WHERE rel_type IN ('SUPPLIES', 'CONTAINS')
       UNION ALL SELECT 2, count(*), 1 FROM edges WHERE rel_type <> 'INFLUENCES' UNION ALL SELECT 3, count(*), 0 FROM edges""",
)
_TOPICS = (("high_risk_suppliers", "Supplier", "risk"), ("warehouse_stress", "Warehouse", "risk"), ("late_modes", "Shipment", "risk"), ("product_risk", "Product", "risk"),
           ("hub_products", "Product", "degree"), ("hub_modes", "Shipment", "degree"), ("busy_months", "CalendarEvent", "degree"), ("active_customers", "Customer", "degree"))


def corpus_export(n, e):
    """Eight fixed graph questions with their ten leading rows as JSON records, written as text and read back."""
    spark, path = n.sparkSession, work_path(n.sparkSession, "corpus")
    d, out = n.join(G.degrees(e).select("node_id", F.col("degree").cast("double").alias("degree")), "node_id"), None
    for topic, label, measure in _TOPICS:
        top = d.where(F.col("label") == label).orderBy(F.desc(measure), "node_id").limit(10).select(
            F.lit(topic).alias("topic"), "name", r(F.col(measure), 4).alias("value"))
        out = top if out is None else out.unionByName(top)
    lead = out.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top_value"))
    lead.select(F.to_json(F.struct("topic", F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" rows.")).alias("answer"), "top_value")).alias("value")).write.text(path)
    return spark.read.schema("topic string, answer string, top_value double").json(path)


graph_query(
    "corpus_export", corpus_export,
    " UNION ALL ".join(
        f"""SELECT '{t}' AS topic, 'Found ' || count(*) || ' rows.' AS answer, round(max(v), 4) AS top_value FROM (
          SELECT CAST({m} AS DOUBLE) AS v FROM nodes JOIN deg USING (node_id) WHERE label = '{lb}' ORDER BY v DESC LIMIT 10)""" for t, lb, m in _TOPICS),
)
