"""Word overlap, grounding, keyword tags and vector similarity as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword of a text to the kind of entity or relation or intent it speaks of.
ENTITY_WORDS = {
    "Supplier": ("supplier", "suppliers", "vendor"), "Product": ("product", "products", "category"),
    "Warehouse": ("warehouse", "warehouses", "storage"), "Shipment": ("shipment", "shipments", "shipping", "delivery"),
    "Customer": ("customer", "customers"), "Order": ("order", "orders"), "CalendarEvent": ("calendar", "event", "holiday"),
}
INTENTS = {
    "risk": "risk|risky|dangerous|critical|vulnerable", "performance": "performance|efficient|efficiency|delay|late|slow",
    "connection": "connect|related|linked|associated|neighbor", "path": "path|route|reach|between|from.*to",
    "top": "top|best|worst|highest|lowest|most|least", "count": "how many|count|total|number of",
}


def words(c: str | Column) -> Column:
    """Distinct lower-case ASCII words of a text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def token_overlap(text: str, query: list[str]) -> Column:
    """0.3 plus 0.7 times the share of query words found in the text."""
    low = F.lower(F.col(text))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in query), F.lit(0))
    return F.least(0.3 + hits / len(query) * 0.7, F.lit(1.0))


def grounding(pairs: DataFrame, answer: str, evidence: str) -> DataFrame:
    """Share of answer words found among the evidence words; below 0.2 of 0.5 + share the answer is rejected."""
    a, b = words(answer), words(evidence)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.lit(1))), F.lit(0.0))
    return pairs.withColumn("share", share).withColumn("status", F.when(F.col("share") < 0.2, "rejected").otherwise("passed"))


def first_match(text: Column, rules: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def keyword_tags(df: DataFrame, text: str) -> DataFrame:
    """Intent of a text by the first matching pattern, and one flag per kind of entity it names."""
    low = F.lower(F.col(text))
    return df.withColumn("intent", first_match(low, INTENTS, "general")).withColumns({
        f"names_{k.lower()}": F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in ws])).cast("int") for k, ws in ENTITY_WORDS.items()
    })


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key in long form (key, pos, value), scaled to unit length; averaged before the shuffle."""
    m = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = m.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(norm, key).select(key, "pos", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"))


def cosine_topk(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k vectors closest to the mean vector of their key; only k rows per key and task reach the ranking.

    A mean vector has the fixed length of the vectors, so putting it together per key stays bounded.
    """
    c = mean_pool(df, key, vector).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("centre"))
    d = df.join(c, key).withColumn("similarity", F.round(cosine(F.col(vector), F.col("centre")), 6))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "vec_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k)
