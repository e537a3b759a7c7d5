"""Language identification with hyperdimensional profiles.

Each letter (lower case; all other characters count as one space) has a random vector of +1 and -1 that follows from its code point. A trigram
is the product of its letters' vectors, the first rotated twice and the second once, so order counts. A document is the sum of its trigrams, a
language the sum of its documents, and a document has the language whose sum has the highest cosine with its own; ties go to the first in
alphabetical order. Sums of languages are made per task and added up, so a language that holds most documents is never in one place.

Null text, and text without a letter, is `und` with score 0. If nothing could be learned, every document is `und`. Documents without a lang are
not learned from. A null doc_id is never held out. Repeated rows count each time. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import documents, fold, kind, text_chunks, words_of

WIDTH = 512
CHUNK = 1 << 20
CHUNK_ROWS = 1_024  # short texts have many trigrams between them
SMALL = 4  # a corpus pipeline's workers hold other stages' memory as well: slices so many times smaller
OPENINGS = (1, 2, 3, 4, *(round(2 ** (k / 2)) for k in range(5, 61)))  # words of the openings from which the spread of a language's scores is taken: two to a doubling, however long the text
MAX_LANGUAGES = 10_000  # more values than that are no language codes


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the lower-case letter's code point, 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@lru_cache(maxsize=200_000)
def letter_vector(code: int, width: int) -> np.ndarray:
    return np.random.default_rng([7, code]).integers(0, 2, width).astype(np.float32) * 2 - 1


def trigram_counts(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts (rows x trigrams), the trigrams' vectors, and whether each row has a letter."""
    rows = len(offsets) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[offsets]
    found = letters()[codes]
    row = np.repeat(np.arange(rows), np.diff(ends))
    padded, owner = np.zeros(len(codes) + 2 * rows, np.int32), np.repeat(np.arange(rows), np.diff(ends) + 2)
    padded[np.arange(len(codes)) + 2 * row + 1] = found
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0) | (owner[1:] != owner[:-1])
    padded, owner = padded[keep], owner[keep]
    has = np.bincount(owner, weights=padded > 0, minlength=rows) > 0
    used = np.flatnonzero(np.bincount(padded)) if len(padded) else np.zeros(1, np.int64)
    dense = np.zeros(used[-1] + 1, np.int64)
    dense[used] = np.arange(len(used))
    s, k = dense[padded], len(used)
    same = owner[2:] == owner[:-2]
    code, at = ((s[:-2] * k + s[1:-1]) * k + s[2:])[same], owner[2:][same]
    if k**3 <= 1 << 21:
        some = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(k**3, np.int64)
        place[some] = np.arange(len(some))
        code = place[code]
    else:
        some, code = np.unique(code, return_inverse=True)
    n = max(len(some), 1)
    counts = np.bincount(at * n + code, minlength=rows * n).reshape(rows, n).astype(np.float32)
    letter = np.stack([letter_vector(int(c), width) for c in used])
    if not len(some):
        return counts, np.zeros((1, width), np.float32), has
    vectors = np.roll(letter, 2, axis=1)[some // (k * k)] * np.roll(letter, 1, axis=1)[some // k % k] * letter[some % k]
    return counts, vectors, has


def prototypes(docs: DataFrame, width: int = WIDTH) -> dict[str, np.ndarray]:
    """The sum vector of each lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

        for part, data, offsets in text_chunks(batches, CHUNK // SMALL):
            counts, vectors, _ = trigram_counts(data, offsets, width)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + (counts[langs == lang].sum(axis=0, dtype=np.float64) @ vectors)
            if len(sums) > 1000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = docs.filter("lang is not null").select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    return {r["lang"]: np.array([c["x"] for c in r["v"]]) for r in sorted(rows, key=lambda r: r["lang"])}


def profile_table(learned: dict[str, np.ndarray], width: int) -> tuple[list[str], np.ndarray]:
    """The languages something was learned of, and their profiles as unit vectors."""
    names = sorted(n for n, v in learned.items() if np.any(v))
    return names, np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]).astype(np.float32) if names else np.zeros((0, width), np.float32)


def nearest(counts: np.ndarray, vectors: np.ndarray, has: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The profile most like each row, and its cosine; 0 without a letter."""
    sums = counts @ vectors
    cosine = (sums @ table.T) / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return cosine.argmax(axis=1), np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)


def identify(docs: DataFrame, learned: dict[str, np.ndarray], width: int = WIDTH, part_of: int = 1) -> DataFrame:
    """The columns of docs with lang_pred and score; columns of these names are replaced. Slices are `part_of` times smaller, which may round the last digits otherwise."""
    names, table = profile_table(learned, width)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, CHUNK // part_of, rows=CHUNK_ROWS // part_of):
            pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
            if names:
                counts, vectors, has = trigram_counts(data, offsets, width)
                best, score = nearest(counts, vectors, has, table)
                pred = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, "".join(f"`{c}` {kind(docs, c)}, " for c in keep) + "lang_pred string, score double")


def size_class(text: Column) -> Column:
    """1 and up by the number of trigrams: two classes to a doubling."""
    return class_of(F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", " "))))


def class_of(trigrams: Column) -> Column:
    return (F.floor(2 * F.log2(F.greatest(trigrams, F.lit(1)))) + 1).cast("int")


def opening_scores(docs: DataFrame, learned: dict[str, np.ndarray], width: int = WIDTH) -> DataFrame:
    """lang, trigrams and score of the openings of each text that have a letter. Openings are cut in the workers: only texts go there and only numbers come back."""
    names, table = profile_table(learned, width)
    steps, limit, most = np.array(OPENINGS), CHUNK // SMALL, CHUNK_ROWS // SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, limit, rows=most):
            start, end, row = words_of(data, offsets)
            n = np.bincount(row, minlength=part.num_rows)
            first = np.cumsum(n) - n
            words = [np.append(steps[steps < k], k) if k else steps[:0] for k in n]
            owner = np.repeat(np.arange(part.num_rows), [len(w) for w in words])
            if not len(owner) or not names:
                continue
            lo, hi = start[first[owner]], end[first[owner] + np.concatenate(words) - 1]
            size, at = np.cumsum(hi - lo), 0
            while at < len(owner):
                to = min(max(int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")), at + 1), at + most, len(owner))
                cut = [data[i:j] for i, j in zip(lo[at:to], hi[at:to], strict=True)]
                counts, vectors, has = trigram_counts(np.concatenate(cut), np.concatenate([[0], np.cumsum(hi[at:to] - lo[at:to])]), width)
                _, score = nearest(counts, vectors, has, table)
                lang = part.column("lang").take(pa.array(owner[at:to][has]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(counts.sum(axis=1)[has].astype(np.int64)), pa.array(score[has])], ["lang", "trigrams", "score"])
                at = to

    return docs.select("lang", "text").mapInArrow(run, "lang string, trigrams long, score double")


def least_likeness(docs: DataFrame, learned: dict[str, np.ndarray], most: float) -> DataFrame:
    """lang, limits: for each size class the score below which text of that size is clearly not of the language, at most `most`.

    The limit is four standard deviations below the mean score of openings of that size, taken from all texts of the language, each from its first word to its
    whole. A class with fewer than 30 openings has the limit of the next shorter one, or 0: scores grow with the size."""
    scored = opening_scores(docs.filter("lang is not null and text is not null"), learned).withColumn("size", class_of(F.col("trigrams")))
    spread = scored.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), (F.avg("score") - 4 * F.stddev_pop("score")).alias("limit")).filter("n >= 30")
    found: dict[str, dict[int, float]] = {}
    for r in spread.collect():
        found.setdefault(r["lang"], {})[r["size"]] = min(max(r["limit"], 0.0), most)
    rows = []
    for lang, by_size in found.items():
        limits = [0.0]
        for c in range(1, max(by_size) + 1):
            limits.append(by_size.get(c, limits[-1]))
        rows.append((lang, limits[1:]))
    return docs.sparkSession.createDataFrame(rows, "lang string, limits array<double>")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold(4) == 2
    learned = prototypes(docs.filter(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), learned).drop("text")
