"""Filter interaction audit by contractions of contingency tensors.

Every row fails some of k filters, so a part's rows fall into 2^k cells. The cells are counted once; reshaped to a tensor of k axes of length two
(0 pass, 1 fail), any order of the filters is read off it: at a step the axes of the filters before it select "pass", its own axis "pass" or
"fail", the axes after it "all", and an einsum over the selectors of all orders and steps gives every count. No order is ever run over the rows.

The text filters of the query: A under 200 words; B under half of the words distinct; C over 2 % of the characters in A-Z; D a character of
#$%&*|; E the text of a smaller doc_id anywhere in the table. Null text is empty text. Empty text fails A, not B, C or D. Of rows with equal text those with
the smallest doc_id pass E, all of them if they share it; a null doc_id is smaller than none and passes E. A null part is the empty string. A
label counts if any row of the labels says so. Texts are read in pieces, long ones too, so memory follows their distinct words. Other columns
are ignored, whatever their names. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import documents

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_UPPER, _MARKS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
PIECE = 1 << 20  # bytes of a text split into words at once
PARTS = 256  # parts contracted at once


def _words(text: bytes) -> tuple[int, int]:
    """Number of words and of distinct words; ASCII white space parts words, which is what bytes.split does."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        words = text[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    n, distinct = _words(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    chars = len(text.translate(None, _INNER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * chars) << 2 | marked << 3


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part and cell (bit i: fails filter i): part, cell, n, good, toxic.

    Rows leave Python as digest, part and cell. Equal rows are counted before any shuffle on their keys. The first document of a text is found by a
    minimum per digest and joined back on digest and doc_id together, so a text with very many copies never meets in one task.
    """
    id_type = docs.schema["doc_id"].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            cells, digests = [], []
            for t in texts:
                raw = t.as_py()
                cells.append(text_failures(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(cells, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "cell", "digest"],
            )

    judged = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(
        judge, f"doc_id {id_type.simpleString()}, part string, cell int, digest binary"
    )
    rows = judged.groupBy("doc_id", "digest", "part", "cell").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.lit(True).alias("is_first"))
    marked = rows.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", "n", (F.col("cell") + F.when(F.col("is_first") | F.col("doc_id").isNull(), 0).otherwise(16)).alias("cell"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")).alias("spread"),  # rows without an id match nothing: deal them by text
    )
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = marked.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    share = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return labelled.groupBy("part", "cell").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def cells_of(df: DataFrame, part: Column, fails: Mapping[str, Column], good: Column, toxic: Column) -> DataFrame:
    """Cells of any table: `fails` names each filter with its condition of failure; a null condition is no failure."""
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    cell = sum((yes(c) * (1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    return df.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(yes(good)).alias("good"), F.sum(yes(toxic)).alias("toxic")
    )


def contract(tensor: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Measures of every order and step from counts of shape (parts, 3, 2, ..., 2): arrays of shape (parts, orders, k).

    Axis 1 holds the counts of all rows, of good and of toxic ones.
    """
    orders = list(itertools.permutations(range(k)))
    passing, failing, every = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    axes = "abcdefgh"[:k]
    spec = f"xy{axes}," + ",".join(f"os{c}" for c in axes) + "->xyos"

    def selected(pick) -> np.ndarray:
        chosen = np.array([[[pick(order.index(f), step) for f in range(k)] for step in range(k)] for order in orders], np.int64)
        return np.einsum(spec, tensor, *[chosen[:, :, f] for f in range(k)], optimize="greedy")

    kept = selected(lambda at, step: passing if at <= step else every)[:, 0]
    removed = selected(lambda at, step: passing if at < step else failing if at == step else every)
    fails = selected(lambda at, step: failing if at == step else every)[:, 0]
    alone = selected(lambda at, step: failing if at == step else passing)[:, 0]
    by_filter = np.zeros((len(tensor), k), np.int64)
    for o, order in enumerate(orders):
        by_filter[:, order] += removed[:, 0, o]
    shapley = by_filter[:, np.array(orders)]
    return dict(zip(MEASURES, (kept, removed[:, 0], fails - removed[:, 0], alone, removed[:, 1], removed[:, 2], shapley), strict=True))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the measures, for every part, order of the filters and step; `filters` names each bit of `cell` by a letter, eight at most.

    kept: rows left after the step; removed: rows it takes; redundant: rows failing its filter that earlier steps took; unique_fails: rows that fail
    its filter only; good_lost, toxic_lost: labelled rows it takes; shapley: rows its filter takes, summed over all orders.
    """
    k = len(filters)
    if not 1 <= k <= 8 or len(set(filters)) != k:
        raise ValueError("one to eight filters with different letters")
    size = 1 << k
    names = ["n", "good", "toxic"]
    wide = cells.groupBy("part").agg(*[F.sum(F.when(F.col("cell") == c, F.col(m)).otherwise(0)).alias(f"{m}{c}") for m in names for c in range(size)])
    orders = ["".join(o) for o in itertools.permutations(filters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                counts = np.stack([some.column(f"{m}{c}").to_numpy(zero_copy_only=False) for m in names for c in range(size)], 1).astype(np.int64)
                # Bit 0 of a cell is the first filter; a reshape puts the highest bit on the first axis, so the axes are turned round.
                tensor = counts.reshape(-1, 3, *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                found = contract(tensor, k)
                parts, per = some.num_rows, len(orders) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(np.repeat(np.arange(parts), per))),
                        pa.array(np.tile(np.repeat(np.array(orders, object), k), parts), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), parts * len(orders)), pa.int32()),
                        *[pa.array(found[m].reshape(-1), pa.int64()) for m in MEASURES],
                    ],
                    ["part", "filter_order", "step", *MEASURES],
                )

    return wide.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first_id < w.doc_id, false)} AS x
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, x),
k(s) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic,
    list_transform(string_split(filter_order, ''), lambda q: CASE q WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fl
  FROM c, o, range(1, 6) g(step)),
m AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fl[step] AS own, list_contains(fl[1:step - 1], true) AS before,
    list_sum(list_transform(fl, lambda q: q::int)) AS fails FROM r),
g AS (
  SELECT part, filter_order, step::int AS step, letter, sum(CASE WHEN NOT before AND NOT own THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN NOT before AND own THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN before AND own THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN NOT before AND own THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN NOT before AND own THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley
FROM g
"""
