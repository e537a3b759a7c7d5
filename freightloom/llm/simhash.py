"""Document fingerprints: SimHash with column functions only.

A term is a word with its successor (the last word stands alone), so the order of words counts. Each occurrence hashes to 64 bits; a one bit
votes with the term's number of code points for the bit, a zero bit against it. 32 sums hold two 32-bit counters each, so a document needs 32
sums instead of 64 and votes add up before the shuffle, in which every document is one row.

Near fingerprints: 64 bits are cut into `radius + 2` blocks. Two fingerprints within the radius agree in two blocks at least, so each pair of
blocks, moved to the front, is a table keyed by its bits. A pair of fingerprints is taken from the first table in which it meets.

Null text counts as empty; a text without words has the fingerprint 0. A null doc_id sorts before all others. Repeated rows are rows of their
own, each the neighbour of the next. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freightloom.llm.common import SPACES, documents, kept_table

PAIR_OF_LANES = (1 << 32) | 1
LAST = 1 << 40


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """One row per term: hash h and weight w; one row with weight 0 for a text without words."""
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    zipped = df.withColumn("_words", words).withColumn("_terms", F.explode_outer(F.arrays_zip("_words", F.expr("slice(_words, 2, size(_words))").alias("_next"))))
    a, b = F.col("_terms._words"), F.col("_terms._next")
    return zipped.select(
        *[c for c in df.columns if c != text], F.xxhash64(a, b).alias("h"),
        (F.coalesce(F.char_length(a), F.lit(0)) + F.coalesce(F.char_length(b), F.lit(0))).cast("long").alias("w"),
    )


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp, the 64-bit fingerprint of each row's text. The keys must name a row."""
    terms = with_terms(df.select(*keys, text), text)
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR_OF_LANES)) * F.col("w")).alias(f"_v{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum("w").alias("_total"), *lanes)
    bits = []
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_v{i}", 32)
        bits += [(low, i), (high, i + 32)]
    fp = F.lit(0).cast("long")
    for count, i in bits:
        value = (1 << i) if i < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * count > F.col("_total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def neighbours(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (q, fp) of distinct fingerprints: all fp of the table `fps` within `radius` bits of a q of the table `queries`."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    tables = []
    for i, j in combinations(range(blocks), 2):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in (i, j))
        tables.append(mask - (1 << 64) if mask >> 63 else mask)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(tables)])
        return df.select(name, F.explode(each).alias("_k")).select(name, "_k.t", "_k.key")

    both = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        first = F.when(both.bitwiseAND(F.lit(tables[t]).cast("long")) == 0, F.lit(t)).otherwise(first)
    left = keyed(queries.select(F.col("q")).distinct(), "q").withColumnsRenamed({"t": "qt", "key": "qkey"})
    right = keyed(fps.select(F.col("fp")).distinct(), "fp")
    near = (F.col("qt") == F.col("t")) & (F.col("qkey") == F.col("key")) & (F.bit_count(both) <= radius) & (first == F.col("t"))
    return left.join(right, near).select("q", "fp")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, a row key, and the text and row key of the next document in ascending doc_id (after the last: the first).

    Rows are dealt to ranges of ids with about as many rows each and ordered within a range. The first row of a range, read by its id, also
    closes the range before, so one shuffle of the texts is all. The ranges' bounds are the only thing the driver sees.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"))
    shares = [(i + 1) / buckets for i in range(buckets - 1)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx("_id", shares, 10000).alias("b")).first()["b"] or []))
    cut = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("_bucket", F.size(F.filter(cut, lambda b: b <= F.col("_id"))).cast("long"))
    edges = sorted((r["_bucket"], r["m"]) for r in rows.groupBy("_bucket").agg(F.min("_id").alias("m")).collect())
    rows = rows.withColumn("_closes", F.lit(None).cast("long"))
    if edges:
        before = [edges[i - 1][0] for i in range(len(edges))]
        closing = F.create_map(*[F.lit(x).cast("long") for (_, m), p in zip(edges, before, strict=True) for x in (m, p)])
        heads = rows.filter(F.col("_id").isin([m for _, m in edges]))
        rows = rows.unionByName(heads.withColumns({"_closes": F.col("_bucket"), "_bucket": closing[F.col("_id")]}))
    order = W.partitionBy("_bucket").orderBy(F.col("_closes").isNotNull(), "_id", "text")
    ranked = rows.select(
        "*", F.row_number().over(order).alias("_n"), F.lead("_closes").over(order).alias("_closed"), F.lead("text").over(order).alias("next_text"),
    ).filter(F.col("_closes").isNull())
    return ranked.select(
        "doc_id", "text", "next_text", (F.col("_bucket") * LAST + F.col("_n")).alias("row_key"),
        F.when(F.col("_closed").isNotNull(), F.col("_closed") * LAST + 1).otherwise(F.col("_bucket") * LAST + F.col("_n") + 1).alias("next_key"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; n_near counts other documents within 3 bits, for ids divisible by 50."""
    pairs = with_next(documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.substring(F.col("next_text"), F.lit(1), half))
    both = pairs.select("doc_id", "row_key", "next_key", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    version = F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"), F.sha2(F.col("edited"), 256).alias("sha")),
    ))
    versions = both.select("doc_id", "row_key", "next_key", "n_chars", version.alias("x")).select("doc_id", "row_key", "next_key", "n_chars", "x.v", "x.sha", F.col("x.t").alias("text"))
    fps = kept_table(fingerprints(versions, ["doc_id", "row_key", "next_key", "n_chars", "v", "sha"]), "op7")
    own = fps.filter("v = 0").select("doc_id", "row_key", "next_key", "n_chars", "fp")
    near = near_counts(own, 3)
    return (
        own.join(fps.filter("v = 1").select("row_key", "sha", F.col("fp").alias("efp")), "row_key")
        .join(own.select(F.col("row_key").alias("next_key"), F.col("fp").alias("nfp")), "next_key")
        .join(near, "row_key", "left")
        .select(
            "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("efp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_near",
        )
    )


def near_counts(own: DataFrame, radius: int) -> DataFrame:
    """row_key and n_near, the number of other rows within the radius, of the rows whose doc_id is divisible by 50."""
    asked = own.filter("doc_id % 50 = 0").select("row_key", F.col("fp").alias("q"))
    sizes = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    found = neighbours(asked, sizes, radius).join(sizes, "fp").groupBy("q").agg((F.sum("n") - 1).alias("n_near"))
    return asked.join(found, "q").select("row_key", "n_near")
