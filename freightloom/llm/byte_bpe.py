"""Byte-level BPE with the tokenizers library over Arrow batches.

A vocabulary of ranks (token bytes and their rank, which is also their id) becomes a model of the library: bytes are written as the printable characters of
the usual byte table, and every token of several bytes names the two tokens it is merged from, found by running the merges of lower rank
over its own bytes. Texts are split by the public pattern, each match is mapped to characters and merged. Decoding reverses the byte table and
joins the bytes of all ids before it reads them as UTF-8, so a character split over several tokens comes back whole; bytes that are no UTF-8 give U+FFFD.

Null text is empty text; empty text has no ids. There are no special tokens: their strings are ordinary text. Null ids decode to null. Rows are
independent, repeated ones give repeated results, an empty table gives an empty table. A long text is cut before a space that follows another
character than white space, where the pattern always parts, and its parts are encoded in turn. Columns named like a result are replaced, others are kept.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from freightloom.llm.common import documents

PART = 1 << 18  # characters of a long text encoded at once
SLICE = 1 << 20  # characters of a batch encoded at once


def byte_table() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def parents(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge gives `token`, or none if merges of lower rank do not lead to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_table()
        written = lambda token: "".join(table[b] for b in token)
        by_rank = sorted(ranks, key=ranks.__getitem__)
        pairs = [p for t in by_rank if len(t) > 1 and (p := parents(t, ranks))]
        model = models.BPE({written(t): r for t, r in ranks.items()}, [(written(a), written(b)) for a, b in pairs], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.reverse = {c: b for b, c in enumerate(table)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in self.tokenizer.get_vocab().items():
            self.tokens[i] = bytes(self.reverse[c] for c in t)
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= )").search

    def parts(self, text: str) -> list[str]:
        if len(text) <= PART:
            return [text]
        out, start = [], 0
        while start < len(text):
            m = self.cut(text, start + PART) if start + PART < len(text) else None
            end = m.start() if m else len(text)
            out.append(text[start:end])
            start = end
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for ids, _, _ in self._encode(texts, False)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and the code points [start, end) each covers. Tokens of one split character all cover it."""
        return list(self._encode(texts, True))

    def _encode(self, texts: list[str], offsets: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at]) <= SLICE):
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            cut = [self.parts(t) for t in some]
            if len(some) > 1:
                encode = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
                done = iter(encode([p for ps in cut for p in ps], add_special_tokens=False))
            else:  # one long text: its parts in turn
                done = (self.tokenizer.encode(p, add_special_tokens=False) for p in cut[0])
            for ps in cut:
                ids, spans, base = [], [], 0
                for p in ps:
                    e = next(done)
                    ids.append(np.array(e.ids, "<u4"))
                    if offsets:
                        spans.append(np.array(e.offsets, np.int64).reshape(-1, 2) + base)
                    base += len(p)
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                yield np.concatenate(ids), flat[:, 0], flat[:, 1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _others(batch: pa.RecordBatch, new: list[str]) -> tuple[list[pa.Array], list[str]]:
    rest = [i for i, n in enumerate(batch.schema.names) if n not in new]
    return [batch.column(i) for i in rest], [batch.schema.names[i] for i in rest]


def _schema(df: DataFrame, new: dict[str, str]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new]
    return ", ".join([*kept, *[f"{n} {t}" for n, t in new.items()]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


def encode(df: DataFrame, ranks: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with ids, starts and ends (arrays of int): each token's id and the code points of the text it covers."""
    new = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = c.encode_with_offsets([t or "" for t in part.column(text).to_pylist()])
                columns, names = _others(part, list(new))
                yield pa.RecordBatch.from_arrays([*columns, *[_lists([f[i] for f in found]) for i in range(3)]], [*names, *new])

    return df.mapInArrow(run, _schema(df, new))


def decode(df: DataFrame, ranks: str, ids: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with decoded (string): the text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [None if x is None else c.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                columns, names = _others(part, ["decoded"])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], [*names, "decoded"])

    return df.mapInArrow(run, _schema(df, {"decoded": "string"}))


def round_trip(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Number and digest of the ids, and digest of the bytes they decode to; the ids themselves stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows = [
                    (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
                    for ids, _, _ in c._encode([t or "" for t in part.column("text").to_pylist()], False)
                ]
                n, coded, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
