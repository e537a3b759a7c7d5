"""Token ids as Parquet files made for partial reads.

Documents are ranged by id into files; in a file they stand in ascending id order in row groups of 32 MB, the ids
are a list column in a delta encoding (no dictionary that would fall back), statistics and page indexes are written, and
doc_id and n_tokens are columns of their own: metadata is read without touching the ids, and the ids of a range of documents without the
rest of the file. Files are written by Spark's own writer under those settings. A manifest gives the ids before each file.

Null text counts as empty, so it has the end id alone. A null doc_id sorts before all others. Repeated rows are written as often as they come.
An empty table writes no document. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freightloom.llm.common import LOWER, documents, text_chunks
from freightloom.session import work_path

REMEMBERED = 500_000
WIDE_SPACES = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # white space of the tokenizer beyond ASCII
BREAK = "\x01"  # stands between the words of one call; the byte occurs in no other character, and words that hold it are encoded alone
SLICE = 4 << 20  # bytes of text whose distinct words are looked up together
A_CALL = 200  # words of one call
# Bytes between whose kinds the tokenizer's own pattern always cuts. The apostrophe and the signs of special tokens are of no kind.
PART = np.zeros(256, np.int8)
PART[97:123] = 1
PART[48:58] = 2
PART[list(b'.,;:!?()[]{}"-_/*#+=%&$@')] = 3
WRITER = {  # fixed values of the file format
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}


class WordIds(dict):
    """word -> ids as little-endian unsigned 32-bit integers; unknown words go to the library in one call per batch."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.breaks = self.library.encode(BREAK, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Words are encoded many to a call, with a break between any two that has an id of its own."""
        new = list(words.difference(self))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        alone = new if len(self.breaks) != 1 else [w for w in new if BREAK in w]
        for w, ids in zip(alone, self.ids(alone), strict=True):
            self[w] = ids.tobytes()
        if len(self.breaks) != 1:
            return
        joined = [w for w in new if BREAK not in w]
        calls = [joined[k : k + A_CALL] for k in range(0, len(joined), A_CALL)]
        for call, ids in zip(calls, self.ids([f" {BREAK} ".join(c) for c in calls]), strict=True):
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.breaks[0]) * 4).tolist()
            for w, first, last in zip(call, [0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True):
                self[w] = data[first:last]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))


def split(data: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """The words of each text, cut further between letters, digits and marks of ASCII.

    The tokenizer ignores case; A-Z are lowered here so that a word is remembered once. Special tokens' strings keep their case.
    """
    low = LOWER[data]
    part = PART[low]
    cuts = np.flatnonzero((part[:-1] != part[1:]) & (part[:-1] > 0) & (part[1:] > 0)) + 1
    moved = offsets + np.searchsorted(cuts, offsets)
    plain = _strings(np.insert(low, cuts, 32), moved)
    special = pc.match_substring(plain, "<|")
    if pc.any(special).as_py():
        plain = pc.if_else(special, _strings(np.insert(data, cuts, 32), moved), plain)
    if pc.any(pc.match_substring_regex(plain, WIDE_SPACES)).as_py():
        plain = pc.replace_substring_regex(plain, WIDE_SPACES, " ")
    return pc.ascii_split_whitespace(plain)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids. The tokenizer drops white space and never joins across it, so words are encoded one by one, each distinct one of a slice once."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for part, data, offsets in text_chunks(batches, SLICE):
            words = split(data, offsets)
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            known.learn(set(distinct))
            ids = [known[w] for w in distinct]
            # One row of ids for each distinct word, and the end id as one more word behind each document.
            size = np.array([len(x) // 4 for x in ids] + [1])
            pool = np.frombuffer(b"".join(ids) + np.array([end_id], "<u4").tobytes(), "<u4")
            ends = words.offsets.to_numpy() - words.offsets[0].as_py()
            order = np.insert(coded.indices.to_numpy(), ends[1:], len(ids))
            n = size[order]
            last = np.cumsum(n)
            out = pool[np.repeat((np.cumsum(size) - size)[order] - last + n, n) + np.arange(n.sum())]
            bounds = np.concatenate([[0], last])[ends + np.arange(len(ends))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(bounds, out.astype(np.int32))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None) -> None:
    """Write the token files below `path`. Files hold ascending, disjoint ranges of doc_id."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = encoded(ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first()), tokenizer, end_id)
    rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (only if wanted) of the token files; filters on doc_id skip files, row groups and pages."""
    rows = spark.read.parquet(path)
    return rows if with_ids else rows.drop("ids")


def starts(rows: DataFrame) -> DataFrame:
    """file, doc_id, n_tokens, start: the ids of all documents before each, in ascending doc_id.

    Sums within a file are a window over the file; files are put in order by their smallest id, a table with one row per file.
    """
    at = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "doc_id", "n_tokens")
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens")]
    inside = at.withColumn("_before", F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per_file = at.groupBy("file").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("_first"), F.sum("n_tokens").alias("_n"))
    base = per_file.select("file", F.coalesce(F.sum("_n").over(W.orderBy("_first", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return inside.join(base, "file").select("file", "doc_id", "n_tokens", (F.col("_base") + F.col("_before")).alias("start"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id and the crc32 of the ids read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(crc, pa.int64())], [*keys, "ids_crc32"])

    keys = [c for c in rows.columns if c != "ids"]
    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, read them back, and give each document's place and checksum."""
    path = work_path(spark, "op6")
    write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = read(spark, path)
    sums = checksums(rows.select("doc_id", "n_tokens", F.col("ids")))
    order = W.partitionBy("doc_id").orderBy("n_tokens", "ids_crc32")
    place = starts(read(spark, path, with_ids=False))
    numbered = sums.withColumn("_k", F.row_number().over(order))
    placed = place.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy("n_tokens", "start")))
    same = numbered["doc_id"].eqNullSafe(placed["doc_id"]) & (numbered["_k"] == placed["_k"])
    return numbered.join(placed, same).select(numbered["doc_id"], placed["start"], numbered["n_tokens"], "ids_crc32")
