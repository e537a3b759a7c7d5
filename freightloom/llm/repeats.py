"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts anywhere else.

1. Each string of `length` bytes has an anchor, the gram with the smallest hash in it. Neighbouring starts with one anchor form a context:
   the bytes their strings cover. Equal strings have equal anchors, so only contexts with an anchor that occurs again matter.
2. Equal contexts become one, with a weight. An anchor whose contexts are all equal is decided: all its starts repeat if the weight is over 1.
3. The other contexts, each once, go to tasks by anchor. A task sorts the suffixes of its contexts to `length` bytes, takes their
   Burrows-Wheeler transform, and finds the borders between suffixes with a common prefix shorter than `length` by breadth-first backward extension
   of intervals, one length after the other, stopping at `length`. Suffixes without a border between them start with the same string.
4. Anchors with more than `crowd` different contexts (one passage in very many surroundings) would fill a task: their strings are hashed
   one by one and counted with a normal aggregation, which is exact as well.

Hashes have 64 bits and more; contexts are keyed by the hash of the anchor and their own. Null text is empty. Texts shorter than `length` stay
whole. Repeated rows are copies of each other. A null doc_id is an id like another. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import documents, kept_table, kind, mix, powers, prefix_hash, substring_hash, text_chunks

LENGTH = 400
GRAM = 48
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each string of `length` bytes: the gram in it with the smallest hash, the last one on a tie.

    Equal strings have equal anchors at the same place. Returns for each run of neighbouring starts with one anchor: hash of the
    anchor, its position, first start, last start, row.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none, none
    width = length - gram + 1
    sums = prefix_hash(data)
    hashes = mix((sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    key = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = row[:starts] == row[length - 1 : length - 1 + starts]
    s = np.flatnonzero(valid)
    p, r = place[s], row[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return hashes[p[first]], p[first], s[first], s[last], r[first]


SLICE = 1 << 20  # text bytes anchored at once; the arrays of a slice take about 120 bytes a byte
PIECE = 1 << 20  # longer texts are anchored in pieces that overlap by length - 1
BATCH = 1500 << 10  # bytes of contexts sorted together
CROWD = 4096
_SEED = 7  # symbols compared at once by the first sort


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """hash, ch (hash of the context), _repeats_id, _repeats_th, start, n: one row for each context. `_repeats_id` and `_repeats_th` name a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, SLICE):
            ids, th = part.column("_repeats_id").to_numpy(zero_copy_only=False), part.column("_repeats_th").to_numpy(zero_copy_only=False)
            step = PIECE if part.num_rows == 1 and len(data) > PIECE + length else len(data)
            for at in range(0, max(len(data) - length + 1, 0), max(step, 1)):
                piece = data[at : at + step + length - 1]
                ends = offsets if step == len(data) else np.array([0, len(piece)])
                h, _, first, last, row = anchors(piece, ends, length)
                ch = substring_hash(prefix_hash(piece), first, last + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(ids[row]), pa.array(th[row]), pa.array(first - offsets[row] + at), pa.array((last - first + 1).astype(np.int32))],
                    ["hash", "ch", "_repeats_id", "_repeats_th", "start", "n"],
                )

    return docs.select("_repeats_id", "_repeats_th", "text").mapInArrow(run, "hash long, ch long, _repeats_id long, _repeats_th long, start long, n int")


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols (ties in any order), and the borders between different first _SEED symbols.

    Symbols are positive; the end counts as smaller than all. Prefix doubling: each round orders the suffixes still tied by the ranks of what follows.
    """
    n = len(symbols)
    padded = np.zeros(n + _SEED, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for j in range(_SEED):
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    seed = fresh.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = _SEED
    while h < depth:
        step = min(h, depth - h)
        lone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~lone)
        if not len(slots):
            break
        pos = order[slots]
        after = pos + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        k = (rank[pos].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(k)
        k, pos = k[by], pos[by]
        order[slots] = pos
        new = np.ones(len(slots), bool)
        new[1:] = k[1:] != k[:-1]
        fresh[slots] = new
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        h += step
    return order, seed


def short_borders(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """order, border: border[i] is true if suffixes order[i - 1] and order[i] have fewer than `length` symbols in common.

    Backward extension over the Burrows-Wheeler transform: the interval of a string, put through the LF mapping, gives the intervals of
    that string with one more symbol in front. An interval is carried on only if its right border is new, so all rounds together
    set each border once.
    """
    n = len(symbols)
    order, border = suffix_order(symbols, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lf = np.where(order > 0, place[order - 1], -1)
    front = symbols[order]
    border = np.append(border, True)
    left = np.flatnonzero(border[:-1])
    right = np.append(left[1:], n)
    for _ in range(_SEED + 1, length + 1):
        if not len(left):
            break
        size = right - left
        ends = np.cumsum(size)
        parent = np.repeat(np.arange(len(left)), size)
        to = lf[np.arange(ends[-1]) - np.repeat(ends - size, size) + left[parent]]
        if (to < 0).any():
            parent, to = parent[to >= 0], to[to >= 0]
        by = np.argsort(to)
        to, parent = to[by], parent[by]
        if not len(to):
            break
        c = front[to]
        starts = np.ones(len(to), bool)
        starts[1:] = (to[1:] != to[:-1] + 1) | (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(starts)
        left, right = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        new = ~border[right]
        left, right = left[new], right[new]
        border[right] = True
    return order, border[:-1]


def repeated_starts(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts whose string of `length` bytes occurs more than once in all contexts, weights counted."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    valid = ends[owner] - np.arange(len(data)) >= length
    order, border = short_borders(data.astype(np.uint64) + np.uint64(1), length)
    group = np.cumsum(border) - 1
    count = np.bincount(group, weights=np.where(valid, weights[owner], 0)[order], minlength=1)
    hit = np.zeros(len(data), bool)
    hit[order] = count[group] > 1
    hit &= valid
    return [np.flatnonzero(hit[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1]


def _search(contexts: DataFrame, length: int) -> DataFrame:
    """hash, ch, lo, hi (arrays): the runs of repeated starts of each context that has some. Contexts of an anchor stand together."""
    schema = "hash long, ch long, lo array<int>, hi array<int>"

    def found(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        each = repeated_starts([r[3] for r in rows], np.array([r[2] for r in rows], float), length)
        out = [(r[0], r[1], *[x.tolist() for x in _runs(s)]) for r, s in zip(rows, each, strict=True) if len(s)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["hash", "ch", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for h, ch, w, ctx in zip(*[b.column(c).to_pylist() for c in ("hash", "ch", "weight", "ctx")], strict=True):
                if rows and rows[-1][:2] == (h, ch):
                    continue  # a text that is there twice gives its contexts twice
                if size >= BATCH and rows[-1][0] != h:
                    yield found(rows)
                    rows, size = [], 0
                rows.append((h, ch, w, ctx))
                size += len(ctx)
        if rows:
            yield found(rows)

    return contexts.select("hash", "ch", "weight", "ctx").mapInArrow(run, schema)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same by hashing every string: for anchors with too many different contexts for one task."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ctx = np.frombuffer(b.column("ctx")[k].as_py(), np.uint8)
                n = len(ctx) - length + 1
                at = np.arange(n)
                sums = prefix_hash(ctx)
                key = substring_hash(sums, at, at + length)
                rest = [pa.array(np.full(n, b.column(c)[k].as_py())) for c in ("hash", "ch", "weight")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(at), pa.array(key.view(np.int64))], ["hash", "ch", "weight", "at", "key"])

    rows = contexts.select("hash", "ch", "weight", "ctx").mapInArrow(strings, "hash long, ch long, weight long, at long, key long")
    again = rows.groupBy("hash", "key").agg(F.sum("weight").alias("n")).filter("n > 1").select("hash", "key")
    starts = rows.join(again, ["hash", "key"]).groupBy("hash", "ch").agg(F.array_sort(F.collect_list(F.col("at").cast("int"))).alias("lo"))
    return starts.select("hash", "ch", "lo", F.col("lo").alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """_repeats_id, _repeats_th, spans (array of start, end): the bytes to remove, for texts that have some. docs: _repeats_id, _repeats_th, text."""
    found = kept_table(anchor_table(docs, length), "op9-anchors")
    again = kept_table(found.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash"), "op9-hashes")
    occurrences = kept_table(found.join(again, "hash"), "op9-again")
    first = F.min(F.struct("_repeats_id", "_repeats_th", "start", "n")).alias("at")
    distinct = kept_table(occurrences.groupBy("hash", "ch").agg(F.count(F.lit(1)).alias("weight"), first), "op9-contexts")
    variety = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("variety"))
    grouped = distinct.join(variety, "hash")
    alone = grouped.filter("variety = 1").select("hash", "ch", F.array(F.lit(0)).alias("lo"), F.array(F.col("at.n") - 1).alias("hi"))
    asked = grouped.filter("variety > 1").select("hash", "ch", "weight", "variety", "at._repeats_id", "at._repeats_th", "at.start", "at.n")
    texts = docs.select("_repeats_id", "_repeats_th", "text")
    wanted = asked.groupBy("_repeats_id", "_repeats_th").agg(F.collect_list(F.struct("hash", "ch", "weight", "variety", "start", "n")).alias("asked"))
    contexts = _cut(texts.join(wanted, ["_repeats_id", "_repeats_th"]), length)
    if variety.filter(F.col("variety") > crowd).limit(1).count():
        contexts = kept_table(contexts, "op9-cut")
        runs = alone.unionByName(_counted(contexts.filter(F.col("variety") > crowd).dropDuplicates(["hash", "ch"]), length))
        contexts = contexts.filter(F.col("variety") <= crowd)
    else:
        runs = alone
    runs = runs.unionByName(_search(contexts.repartition("hash").sortWithinPartitions("hash", "ch"), length))
    spans = occurrences.join(runs, ["hash", "ch"]).select("_repeats_id", "_repeats_th", F.explode(F.arrays_zip("lo", "hi")).alias("x"), "start")
    return spans.groupBy("_repeats_id", "_repeats_th").agg(F.collect_set(F.struct((F.col("start") + F.col("x.lo")).alias("a"), (F.col("start") + F.col("x.hi") + length).alias("b"))).alias("spans"))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """The asked contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                part = batch.slice(k, 64)
                for text, asked in zip(part.column("text"), part.column("asked"), strict=True):
                    data = (text.as_py() or "").encode()
                    out += [(x["hash"], x["ch"], x["weight"], x["variety"], data[x["start"] : x["start"] + x["n"] + length - 1]) for x in asked.as_py()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["hash", "ch", "weight", "variety", "ctx"])

    return rows.select("text", "asked").mapInArrow(run, "hash long, ch long, weight long, variety long, ctx binary")


def named(docs: DataFrame) -> DataFrame:
    """docs with _repeats_id and _repeats_th, which name a text."""
    return docs.withColumns({"_repeats_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_repeats_th": F.xxhash64("text", F.length("text"))})


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """docs with _repeats_spans, null where nothing is to be removed."""
    marked = named(docs)
    found = repeated_spans(marked, length, crowd).withColumnRenamed("spans", "_repeats_spans")
    return marked.join(found, ["_repeats_id", "_repeats_th"], "left").drop("_repeats_id", "_repeats_th")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes removed from text and n_chars set to what is left; a broken character at a cut goes as well. Null text stays null."""
    marked, names = with_spans(docs, length), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text"), b.column("_repeats_spans"), strict=True):
                t = text.as_py()
                if t is not None and spans.as_py():
                    data, kept, at = t.encode(), [], 0
                    for x, y in _union(spans.as_py()):
                        kept.append(data[at:x])
                        at = y
                    t = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)

    cut = marked.select(*names, "_repeats_spans").mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text"), b.column("_repeats_spans"), strict=True):
                data, gone, kept, at = (text.as_py() or "").encode(), 0, hashlib.sha256(), 0
                found = _union(spans.as_py() or [])
                for x, y in found:
                    kept.update(data[at:x])
                    gone, at = gone + y - x, y
                kept.update(data[at:])
                rows.append((len(data), gone, len(found), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs).select("doc_id", "text", "_repeats_spans").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
