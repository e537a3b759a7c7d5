r"""Phrase collocations by SETM: relations of occurrences, mined one length at a time.

The occurrence relation says which word stands at which position of which piece; it is written in blocks of one language, sorted by piece and position, with
a gap between pieces. For each length k it is kept down to the positions where a phrase of k words may start. One turn
- counts the groups: a block's distinct phrases, as hashes with their number there, meet those of the other blocks by hash;
- semi-joins: the hashes found often enough go back to their blocks, and the other occurrences are dropped;
- merge-joins what is left with itself on piece and adjacent position: where a phrase stays at p and another at p + 1, one of k + 1 words may start at p.
Phrases that stay are counted once more by their words, so the hashes only decide what is left out early and never a figure. A block sends a
phrase once however often it holds it, and no phrase is sent to all: nothing is broadcast, and a very frequent phrase is one row a block.

Texts are lower-cased in A-Z and split at [.,;:!?\x0A-\x0D] into pieces and those at space and tab into words. Null text is empty, and empty text or pieces have no words.
A null lang is `und`. Repeated rows count each time. Long texts are read in stretches of whole pieces; memory follows the block size or the longest piece. Other
columns are ignored. An empty table gives no rows. Ties are settled to the end: by count, then by the bytes of the phrase.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightloom.llm.common import documents, kept_table, mix, prefix_hash, substring_hash

BLOCK = 1_000_000  # words of a task's open blocks together, about 6 MB of text; a longer piece makes a longer block
PART = 1 << 17  # phrases, or bytes of words, hashed at once
HASH_BITS = 48  # of the hashes that phrases meet by; fewer bits are fewer bytes to shuffle, and equal hashes of different phrases only let more occurrences stay
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
STRETCH = 1 << 20  # bytes of a text handled at once
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_b] = 10
TABLE = bytes(_TABLE)


def piece_words(text: bytes) -> Iterator[list[bytes]]:
    """Words of each piece that has any. Only space and tab are left as white space inside a piece, so bytes.split parts words."""
    start = 0
    while start < len(text):
        end = start + STRETCH
        if end < len(text):
            found = [p for p in (text.find(mark, end) for mark in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")) if p >= 0]
            end = min(found, default=len(text))
        for piece in text[start:end].translate(TABLE).split(b"\n"):
            words = piece.split()
            if words:
                yield words
        start = end


def pack(numbers: np.ndarray) -> bytes:
    """Compressed 32-bit integers; unpack reads them back."""
    return len(numbers).to_bytes(8, "little") + pa.compress(numbers.astype("<i4").tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = 4 * int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd"), "<i4")


BLOCK_SCHEMA = "block long, lang string, words binary, places binary, starts binary"
_BLOCK_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())


def _block_row(block: int, lang: str, words: bytes, places: np.ndarray, starts: np.ndarray) -> list:
    return [block, lang, words, pack(places), pack(np.diff(starts, prepend=np.int32(0)))]


def word_relation(docs: DataFrame) -> DataFrame:
    """The relation of length 1, a row for each block: its distinct words, the number of the word at each position (-1 between pieces), and the positions
    of words. A block holds pieces of one language of one task, in the order of rows and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 12, 0
        blocks: dict[str, tuple[dict, array]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, (ids, places) in blocks.items():
                where = np.frombuffer(places, np.int32)
                row = _block_row(made, lang, b" ".join(ids), where, np.flatnonzero(where >= 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK_KINDS, strict=True)], ["block", "lang", "words", "places", "starts"])
                made += 1
            blocks.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py()
                if not raw:
                    continue
                name = lang.as_py()
                for words in piece_words(raw):
                    if name not in blocks:
                        ids: dict = defaultdict()
                        ids.default_factory = ids.__len__
                        blocks[name] = (ids, array("i"))
                    ids, places = blocks[name]
                    places.extend([ids[w] for w in words])
                    places.append(-1)
                    held += len(words)
                    if held >= BLOCK:
                        yield from flush()
                        held = 0
        yield from flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _candidates(starts: np.ndarray, length: int) -> np.ndarray:
    """Where a phrase of `length` words may start: all words, or, as a merge join on adjacent positions, where shorter phrases stay at p and p + 1."""
    return starts if length == 1 else starts[:-1][np.diff(starts) == 1]


def _hashes(lang: str, words: bytes, places: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases at the starts; equal phrases of a language have equal ones in all blocks."""
    data = np.frombuffer(words, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    begins = np.append(0, ends[:-1] + 1)
    of_word = np.empty(len(ends), np.uint64)
    at = 0
    while at < len(ends):  # some words at a time, which keeps the arrays small
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + PART, "right")))
        part = prefix_hash(data[begins[at] : ends[upto - 1]])
        of_word[at:upto] = substring_hash(part, begins[at:upto] - begins[at], ends[at:upto] - begins[at])
        at = upto
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    out = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), PART):
        some = starts[at : at + PART]
        acc = np.full(len(some), salt, np.uint64)
        for k in range(length):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + of_word[places[some + k]] + np.uint64(k + 1))
        out[at : at + PART] = (acc >> np.uint64(64 - HASH_BITS)).view(np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """block, lang, words, places, starts of each row, and its array of hashes if it has one."""
    for b in batches:
        for k in range(b.num_rows):
            block, lang, words, places, starts = (b.column(c)[k].as_py() for c in ("block", "lang", "words", "places", "starts"))
            kept = b.column("kept")[k].values if "kept" in b.schema.names else None
            yield block, lang, words, unpack(places), np.cumsum(unpack(starts), dtype=np.int32), None if kept is None else kept.to_numpy()


def frequent_in(relation: DataFrame, length: int, least: int) -> DataFrame:
    """block, kept: the hashes of each block's phrases that all blocks together hold at least `least` times.

    A row is a hash and, in one number, block and count; the rows of a hash are at most one a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, words, places, starts, _ in _blocks(batches):
            h, n = np.unique(_hashes(lang, words, places, _candidates(starts, length), length), return_counts=True)
            at = (np.int64(block) << 20) | np.minimum(n, (1 << 20) - 1)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)]), pa.array(at[i : i + (1 << 16)])], ["h", "at"])

    rows = relation.mapInArrow(run, "h long, at long")
    total = F.sum(F.col("at").bitwiseAND((1 << 20) - 1)).over(Window.partitionBy("h"))
    often = rows.withColumn("total", total).filter(F.col("total") >= least)
    return often.groupBy(F.shiftright("at", 20).alias("block")).agg(F.collect_list("h").alias("kept"))


def semi_join(relation: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """The relation of phrases of `length` words: the occurrences whose phrase is frequent. A block without any goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, words, places, starts, kept in _blocks(batches):
            starts = _candidates(starts, length)
            kept = np.sort(kept)
            h = _hashes(lang, words, places, starts, length)
            stays = starts[kept[np.minimum(np.searchsorted(kept, h), len(kept) - 1)] == h]
            row = _block_row(block, lang, words, places, stays)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK_KINDS, strict=True)], ["block", "lang", "words", "places", "starts"])

    return relation.join(frequent, "block").mapInArrow(run, BLOCK_SCHEMA)


def group_counts(relation: DataFrame, length: int, least: int) -> DataFrame:
    """lang, phrase, a, size: the phrases of `length` words of the relation found at least `least` times, counted by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, words, places, starts, _ in _blocks(batches):
            text = words.split(b" ")
            if length <= 3 and len(text) < 1 << 20:  # three numbers of words fit in one key
                key = np.zeros(len(starts), np.int64)
                for k in range(length):
                    key = (key << 20) | places[starts + k]
                found, n = np.unique(key, return_counts=True)
                found = np.stack([(found >> (20 * (length - 1 - k))) & ((1 << 20) - 1) for k in range(length)], 1)
            else:
                found, n = np.unique(places[starts[:, None] + np.arange(length)], axis=0, return_counts=True)
            for i in range(0, len(n), 1 << 16):
                phrases = pa.array([b" ".join([text[w] for w in row]) for row in found[i : i + (1 << 16)].tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(n[i : i + (1 << 16)])], ["lang", "phrase", "n"])

    counted = relation.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return counted.filter(F.col("a") >= least).withColumn("size", F.lit(length))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits: exact up to counts of 10^16; beyond, an error and no wrong figure."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def _weakest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, size, score, l, r of the lowest-scoring cut, the first of several."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    side = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "size", "k", side(F.lit(1), F.col("k")).alias("head"), side(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    known = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"])
    least = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a", "size").agg(least).select("lang", "phrase", "a", "size", "cut.score", "cut.l", "cut.r")


def _outdone(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: the most occurrences of a longer candidate that holds the phrase."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("size") - size + 1), lambda first: F.array_join(F.slice(F.col("words"), first, size), " "))))
    held = candidates.filter("size > 2").withColumn("words", F.split("phrase", " ", -1))
    return held.select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words by score, count and bytes.

    a: occurrences of the phrase (`least` or more); l, r: those of its two parts at the lowest-scoring cut, the first such cut; n: words of the language;
    score: floor(10^6 a a / (l r)). A phrase goes if a longer candidate that holds it has at least half its occurrences.
    """
    spark = docs.sparkSession
    relation = kept_table(word_relation(docs), "collocations-1")
    words = relation.select("lang", F.substring("starts", 1, 8).alias("starts")).mapInArrow(_word_numbers, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    counted: list[DataFrame] = []
    # A row is a block of some MB, so a task may hold few of them at once.
    batch = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "2")
    try:
        for length in range(1, longest + 1):
            relation = semi_join(relation, frequent_in(relation, length, least), length)
            if length < longest:
                relation = kept_table(relation, f"collocations-{length + 1}")
            counted.append(kept_table(group_counts(relation, length, least), f"collocations-counts-{length}"))
    finally:
        spark.conf.set(BATCH, batch)
    candidates = reduce(DataFrame.unionByName, counted[1:])
    every = _weakest_cuts(candidates, reduce(DataFrame.unionByName, counted))
    if longest > 2:
        every = every.join(_outdone(candidates), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int.from_bytes(x.as_py()[:8], "little") for x in b.column("starts")]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(n, pa.int64())], ["lang", "n"])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM o, range(1, 4) s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 10),
parts AS (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (
  SELECT x.lang, x.phrase, x.a, j, l.f AS l, r.f AS r, (1000000::hugeint * x.a * x.a) // (l.f::hugeint * r.f) AS score
  FROM parts x JOIN g l ON l.lang = x.lang AND l.phrase = x.head JOIN g r ON r.lang = x.lang AND r.phrase = x.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3)
  GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n.n, score::bigint AS score
FROM best b JOIN n USING (lang) LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
