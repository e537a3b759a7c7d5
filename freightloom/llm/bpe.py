"""BPE encoding and decoding with forced boundaries.

A byte pair that stands inside no token of the vocabulary can never be merged over, so text is cut there for certain and the fragments are
encoded one by one and concatenated. Two uses of that: (a) a space after a character other than white space is an edge of the pre-tokenizer's
pieces (and such a pair, but after the one byte that also ends a no-break space), so a text is cut into space-led fragments, which repeat and
are remembered; (b) inside each pre-token the forced cuts of all pairs bound the merge loop by the longest stretch without a cut.

Null text is empty text. Empty text has no ids. Special token strings in a text become their ids, as in the library. Rows are independent:
repeated rows give repeated results, long texts need memory in proportion to their own length, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from freightloom.llm.common import documents

# White space as Unicode defines it; the pre-tokenizer's pattern is the public one of byte-level BPE.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
REMEMBERED = 300_000  # fragments a Python worker keeps


def byte_letters() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies use for bytes: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = [b""] * (max([*self.ids.values(), *[a["id"] for a in spec["added_tokens"]]]) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            left, right = raw(a), raw(b)
            self.merge[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        inside = np.zeros((256, 256), bool)
        for t in self.ids:
            inside[list(t[:-1]), list(t[1:])] = True
        self.cut = [bytes(np.flatnonzero(~inside[a])) for a in range(256)]  # after byte a, a cut is certain before these
        self.cuts = [frozenset(c) for c in self.cut]


def merged(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one fragment: the lowest-ranked pair merges first, the leftmost on a tie."""
    ids = [v.single[b] for b in word]
    if len(ids) < 40:
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                m = v.merge.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids
    n = len(ids)
    after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (m := v.merge.get((ids[i], ids[after[i]]))):
            heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]], m[1]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


class Fragments(dict):
    """fragment -> its ids as little-endian unsigned 32-bit integers. Forgets all when full."""

    def __init__(self, v: Vocabulary, lead: str):
        super().__init__()
        self.v, self.lead, self.words, self.split = v, lead, {}, regex.compile(PATTERN).findall

    def __missing__(self, fragment: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = b"".join([self.word(word.encode()) for word in self.split(self.lead + fragment)])
        if len(fragment) < 100:
            self[fragment] = out
        return out

    def word(self, word: bytes) -> bytes:
        known = self.words.get(word)
        if known is not None:
            return known
        ids, start, cuts = [], 0, self.v.cuts
        for i in range(1, len(word)):
            if word[i] in cuts[word[i - 1]]:
                ids += merged(word[start:i], self.v)
                start = i
        ids += merged(word[start:], self.v)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) < 64:
            self.words[word] = out
        return out


class Codec:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.first, self.rest = Fragments(self.v, ""), Fragments(self.v, " ")
        self.white_space = regex.compile(f"[{WHITE}] ").search
        self.after_text = regex.compile(rf"(?<=[^{WHITE}])(?= )").split
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is not None and self.special.search(text):
            return b"".join(
                np.array([self.v.special[part]], "<u4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.special.split(text)) if part
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.white_space(text) is None:
            head, *rest = text.split(" ")
            return (self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, rest))
        parts = self.after_text(text)
        return b"".join(self.rest[p[1:]] if p[0] == " " else self.first[p] for p in parts if p)

    def forget(self) -> None:
        """Workers are used again by later stages, which need the memory."""
        for f in (self.first, self.rest):
            f.clear()
            f.words.clear()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df with ids (array of int) in place of any column of that name."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(c.encode(t or ""), "<u4") for t in part.column(text).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                rest = [i for i, n in enumerate(part.schema.names) if n != "ids"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.ListArray.from_arrays(ends, flat)], [*[part.schema.names[i] for i in rest], "ids"])

    columns = [f for f in df.schema.fields if f.name != "ids"]
    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + (", " if columns else "") + "ids array<int>")


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """df with decoded (string): the text of each row's ids. Null ids: null."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [None if x.values is None else c.decode(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in part.column(ids)]
                rest = [i for i, n in enumerate(part.schema.names) if n != "decoded"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.array(out, pa.string())], [*[part.schema.names[i] for i in rest], "decoded"])

    columns = [f for f in df.schema.fields if f.name != "decoded"]
    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digest of encoding and decoding: ids never leave the task, which only tells their number and hashes."""
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                ids = c.encode(t.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
