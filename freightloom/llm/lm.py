"""LM scoring: online logistic context mixing.

A text is its words in order, each followed by a space, and an end mark. Every bit of it is predicted: several predictors look up the bit's odds under a
hashed context (the last one to five bytes, across words, and the bytes of the word so far), a mixer adds their log odds with weights chosen by two gates
(how much the longest context has been seen, and the bits so far in the byte), and a last table refines the mixed odds by what came true so far, with a
share that grows where it predicted better. Mixer and table learn online, each task on its own training texts in small steps, each bit left out of its own
counts; the tasks' weights are averaged and their tables added. All parts are normalised, so the score is a log10 probability.

How it runs: three passes over the texts. The first counts bits by context in tables of hashed slots, whose number follows the size of the training texts
(`SLOTS` to `MOST_SLOTS`; beyond, contexts share slots), the second learns online, the third scores. No context reaches back further than five bytes, so
a byte with its contexts is one of few distinct values in a slice of text: each is worked out once and counted as often as it occurs.
For the base, the third pass also turns slices into distinct words with counts, kept by hash bucket, and (word, document, count) postings, kept by slice.
Buckets sum the words over all slices and send counts back to the slices that asked, where they are added per document. A frequent word
is one entry per slice, so no bucket grows with it; the number of buckets follows the input's size.

Null text is empty: an end alone. A null doc_id is a training document. Repeated rows count each time. Without training documents all counts are 0.
Long texts are a slice of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import IS_SPACE, LOWER, documents, fold, kept_table, kind, mix, prefix_hash, substring_hash, text_chunks, words_of

SLICE = 4 << 20
SLICE_ROWS = 1 << 16  # a row's number in its slice takes 16 bits
BUCKET_BYTES = 16 << 20  # text bytes to a bucket of words
TASK_BYTES = 48 << 20  # text bytes to a task that learns
SLOTS, MOST_SLOTS = 1 << 18, 1 << 20
RANGE = 1 << 16  # slots whose counts are summed together
ORDERS = (1, 2, 3, 4, 5)  # and one predictor of the bytes of the word so far
PREDICTORS = len(ORDERS) + 1
REACH = max(ORDERS)
STEP = 2_000  # distinct bytes with contexts to a step of the online run
BLOCK = 8_000  # and to a block that is scored
GATES = 16
CELLS = 24
PRIOR = 0.4
END = 10  # no byte of a word, nor the space after it
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    return len(a.tobytes()).to_bytes(8, "little") + _CODEC.compress(a.tobytes(), asbytes=True)


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), dtype)


def stream_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows' words, each with a space behind it, and their number by row."""
    start, end, row = words_of(data, offsets)
    after = np.cumsum(end - start + 1)
    chars = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    letter = np.ones(len(chars), bool)
    letter[after - 1] = False
    chars[letter] = data[~IS_SPACE[data]]
    return chars, np.bincount(row, weights=end - start + 1, minlength=len(offsets) - 1).astype(np.int64)


def keys_of(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each byte, the rows' end marks included, with the REACH bytes before it in its row (0 before the first) in one number."""
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1]) if len(ends) else 0
    text = np.full(7 + n, END, np.uint8)
    letter = np.ones(n, bool)
    letter[ends - 1] = False
    text[7:][letter] = chars
    key = np.ndarray((n,), ">u8", text, strides=(1,)).astype(np.uint64)  # the eight bytes up to each one, the byte itself lowest
    key &= np.uint64((1 << (8 * (REACH + 1))) - 1)
    for j in range(REACH):  # no context reaches into the row before
        at = (ends - sizes - 1)[sizes >= j] + j
        key[at] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return key


def distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where a new value starts in an ordered array, and the lengths of the stretches."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(ordered)))


class Bits:
    """The bits of some bytes with their contexts: slots of each predictor, the bit, its word (row or key), and the bits so far in the byte."""

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, slots: int = SLOTS):
        self._expand(keys_of(chars, sizes), np.repeat(np.arange(len(sizes)), sizes + 1), slots)

    @classmethod
    def of(cls, keys: np.ndarray, slots: int) -> Bits:
        bits = cls.__new__(cls)
        bits._expand(keys, np.arange(len(keys)), slots)
        return bits

    def _expand(self, keys: np.ndarray, word: np.ndarray, slots: int) -> None:
        byte, before = (keys & np.uint64(255)).astype(np.uint32), keys >> np.uint64(8)
        contexts = [(before & np.uint64((1 << (8 * j)) - 1)) + np.uint64(j << 56) for j in ORDERS]
        inside, in_word = np.zeros(len(keys), np.uint64), np.ones(len(keys), bool)
        for j in range(REACH):
            c = (before >> np.uint64(8 * j)) & np.uint64(255)
            in_word &= (c != 32) & (c != 0)
            inside |= np.where(in_word, c, np.uint64(0)) << np.uint64(8 * j)
        contexts.append(inside + np.uint64(99 << 56))
        self.word = np.repeat(word, 8)
        shifts = np.arange(7, -1, -1, dtype=np.uint32)
        self.bit = ((byte[:, None] >> shifts) & np.uint32(1)).astype(np.int64).ravel()
        so_far = (byte[:, None] | np.uint32(256)) >> (shifts + np.uint32(1))
        self.so_far = so_far.astype(np.int64).ravel()
        node = so_far * np.uint32(0x9E3779B1)
        self.slots = [(((mix(c) >> np.uint64(32)).astype(np.uint32)[:, None] + node) & np.uint32(slots - 1)).astype(np.int64).ravel() for c in contexts]


class Model:
    """Counts of the predictors (slot, bit), the mixer's weights by gate, and the refining table: counts (cell, bit) and the share it earned.

    To score, `looked_up` (log odds of every slot, gate of the longest context's) does instead of the counts.
    """

    def __init__(self, counts: np.ndarray | None, weights: np.ndarray | None = None, refined: np.ndarray | None = None, looked_up: tuple[np.ndarray, np.ndarray] | None = None):
        self.counts = counts  # predictor, slot, bit
        self.weights = np.concatenate([np.full((GATES, PREDICTORS), 0.25), np.zeros((256, PREDICTORS))]) if weights is None else weights
        self.refined = np.zeros((256 * CELLS, 3)) if refined is None else refined
        self._looked_up = looked_up

    @property
    def looked_up(self) -> tuple[np.ndarray, np.ndarray]:
        if self._looked_up is None:
            logs = np.empty(self.counts.shape[:2], np.float16)
            for j, n in enumerate(self.counts):
                logs[j] = np.log((n[:, 1] + np.float32(PRIOR)) / (n[:, 0] + np.float32(PRIOR)))
            self._looked_up = logs, self.gate(self.counts[len(ORDERS) - 1].sum(axis=1, dtype=np.float32)).astype(np.uint8)
        return self._looked_up

    @staticmethod
    def gate(seen: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(seen + 1), GATES - 1).astype(np.int64)

    def odds(self, bits: Bits, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of a one from each predictor, and the gate. leave_out: without one occurrence of the bit itself."""
        x = np.empty((PREDICTORS, len(bits.bit)), np.float32)
        if not leave_out:
            logs, gates = self.looked_up
            for j, slots in enumerate(bits.slots):
                x[j] = logs[j].take(slots)
            return x, gates.take(bits.slots[len(ORDERS) - 1])
        gate, bit = None, bits.bit.astype(np.float32)
        for j, slots in enumerate(bits.slots):
            n = self.counts[j].take(slots, axis=0).astype(np.float32)
            n0, n1 = np.maximum(n[:, 0] - (1 - bit), 0), np.maximum(n[:, 1] - bit, 0)
            x[j] = np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))
            if j == len(ORDERS) - 1:
                gate = self.gate(n0 + n1)
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray, bits: Bits) -> np.ndarray:
        z = np.zeros(x.shape[1])
        for j in range(PREDICTORS):
            z += (self.weights[:GATES, j].take(gate) + self.weights[GATES:, j].take(bits.so_far)) * x[j]
        return np.clip(z, -11.9, 11.9)

    def cell(self, z: np.ndarray, bits: Bits) -> np.ndarray:
        return bits.so_far * CELLS + ((z + 12) * (CELLS / 24)).astype(np.int64)

    def refine(self, p: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The refined probability and its share against the mixed one."""
        n0, n1, earned = (self.refined[:, i].take(cell) for i in range(3))
        return (n1 + 8 * p) / (n0 + n1 + 8), (earned + 1) / (n0 + n1 + 2)

    def learn(self, bits: Bits, times: np.ndarray, rate: float) -> None:
        """One online step: the mixer moves against its error, the refining table counts what came true and how well it foretold it. times: occurrences by byte."""
        times = np.repeat(times, 8).astype(float)
        x, gate = self.odds(bits, True)
        z = self.mixed(x, gate, bits)
        p, cell = 1 / (1 + np.exp(-z)), self.cell(z, bits)
        q, share = self.refine(p, cell)
        hit, miss = np.where(bits.bit == 1, q, 1 - q) * share, np.where(bits.bit == 1, p, 1 - p) * (1 - share)
        error = (bits.bit - p) * times
        for rows, at in ((slice(0, GATES), gate), (slice(GATES, None), bits.so_far)):
            n = GATES if rows.start == 0 else 256
            seen = np.maximum(np.bincount(at, weights=times, minlength=n), 1)
            for j in range(PREDICTORS):
                self.weights[rows, j] += rate * np.bincount(at, weights=error * x[j], minlength=n) / seen
        self.refined[:, :2] += np.bincount(cell * 2 + bits.bit, weights=times, minlength=len(self.refined) * 2).reshape(-1, 2)
        self.refined[:, 2] += np.bincount(cell, weights=times * hit / (hit + miss), minlength=len(self.refined))

    def word_scores(self, bits: Bits, words: int) -> np.ndarray:
        """log10 probability of each word's (row's, key's) bytes."""
        x, gate = self.odds(bits, False)
        z = self.mixed(x, gate, bits)
        p = 1 / (1 + np.exp(-z))
        q, share = self.refine(p, self.cell(z, bits))
        p = np.clip(p + share * (q - p), 1e-6, 1 - 1e-6)
        return np.bincount(bits.word, weights=np.log10(np.where(bits.bit == 1, p, 1 - p)), minlength=words)

    def row_scores(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each row with its end mark: each distinct byte with its contexts is worked out once."""
        key = keys_of(chars, sizes)
        key <<= np.uint64(16)
        key |= np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes + 1)
        key.sort()
        first, times = distinct(key >> np.uint64(16))
        keys = key[first] >> np.uint64(16)
        row = key.astype(np.uint16)
        del key
        slots = self.looked_up[0].shape[1]
        blocks = [keys[x : x + BLOCK] for x in range(0, len(keys), BLOCK)]
        score = np.concatenate([np.zeros(0), *[self.word_scores(Bits.of(b, slots), len(b)) for b in blocks]])
        return np.bincount(row, weights=np.repeat(score, times), minlength=len(sizes))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct bytes with their contexts and how often they occur, for each slice of the texts."""
    for _, raw, offsets in text_chunks(batches, SLICE):
        key = keys_of(*stream_of(LOWER[raw], offsets))
        key.sort()
        first, times = distinct(key)
        yield key[first], times


def fit(docs: DataFrame, slots: int, tasks: int) -> Model:
    """Context counts of every bit of the training texts, then the mixer and refining table of each task's online run, averaged and added."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PREDICTORS, slots * 2), np.uint32)
        seen = False
        for keys, times in _training(batches):
            seen = True
            for x in range(0, len(keys), 16 * BLOCK):
                bits = Bits.of(keys[x : x + 16 * BLOCK], slots)
                n = np.repeat(times[x : x + 16 * BLOCK], 8).astype(float)
                for j, at in enumerate(bits.slots):
                    counts[j] += np.bincount(at * 2 + bits.bit, weights=n, minlength=slots * 2).astype(np.uint32)
        if seen:
            for j in range(PREDICTORS):
                pieces = np.split(counts[j], slots // RANGE)
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array([pack(c) for c in pieces], pa.binary())], ["j", "r", "v"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((RANGE, 2))
        for v in rows["v"]:
            sums += unpack(v, "<u4").reshape(-1, 2)
        sums /= np.maximum(sums.max(axis=1, keepdims=True) / 65535, 1)  # 16 bits hold the odds of frequent contexts as well
        return pd.DataFrame({"j": [int(rows["j"].iloc[0])], "r": [int(rows["r"].iloc[0])], "v": [pack(np.ceil(sums).astype("<u2"))]})

    few = docs.select("text").coalesce(tasks)
    counts = np.zeros((PREDICTORS, slots, 2), np.uint16)
    for row in few.mapInArrow(count, "j int, r int, v binary").groupBy("j", "r").applyInPandas(total, "j int, r int, v binary").toLocalIterator():
        counts[row["j"], row["r"] * RANGE : (row["r"] + 1) * RANGE] = unpack(bytes(row["v"]), "<u2").reshape(RANGE, 2)
    shared = spark.sparkContext.broadcast(counts)  # of bounded size

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, steps, n = Model(shared.value), 0, 0.0
        for keys, times in _training(batches):
            parts = -(-len(keys) // STEP)
            for part in range(parts):  # every `parts`-th key: a step sees all kinds of contexts
                model.learn(Bits.of(keys[part::parts], slots), times[part::parts], 0.1 / (1 + steps / 800))
                steps += 1
            n += float(times.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), *[pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (model.weights, model.refined)]], ["n", "w", "r"],
        )

    learned = kept_table(few.mapInArrow(online, "n double, w array<double>, r array<double>").filter("n > 0"), "op3-learned")
    weights = learned.select("n", F.posexplode("w").alias("i", "x")).groupBy("i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).collect()
    refined = learned.select(F.posexplode("r").alias("i", "x")).filter("x > 0").groupBy("i").agg(F.sum("x").alias("x")).collect()
    model = Model(counts)
    for found, table in ((weights, model.weights), (refined, model.refined)):
        for r in found:
            table.ravel()[r["i"]] = r["x"]
    return model


def gather(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Rows of two kinds. bucket >= 0: part, hashes and training counts of the bucket's words in the slice. bucket = -1: the slice's documents with scores, and postings.

    docs: doc_id, train, text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.refined, model.looked_up))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = (task.partitionId() if task else 0) << 24
        m = Model(None, *shared.value)
        for rows, raw, offsets in text_chunks(batches, SLICE, rows=SLICE_ROWS):
            data = LOWER[raw]
            n = rows.num_rows
            lm = m.row_scores(*stream_of(data, offsets))
            train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
            start, end, doc = words_of(data, offsets)
            hashes, word = np.unique(substring_hash(prefix_hash(data), start, end), return_inverse=True)
            posting, count = np.unique(word.astype(np.int64) * n + doc, return_counts=True)
            word, doc = posting // n, posting % n
            counts = np.bincount(word, weights=np.where(train[doc], count, 0), minlength=len(hashes)).astype(np.uint32)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [(b, part, pack(hashes[x:y]), pack(counts[x:y]), None) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            docs_of = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("train"), pa.array(lm)], ["doc_id", "train", "score"])
            with pa.ipc.new_stream(docs_of, ids.schema) as w:
                w.write_batch(ids)
            per_word = np.bincount(word, minlength=len(hashes)).astype(np.uint32)
            out.append((-1, part, docs_of.getvalue().to_pybytes(), pack(per_word), pack(np.stack([doc, count]).astype(np.uint32))))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["bucket", "part", "a", "b", "c"])
            part += 1

    return docs.mapInArrow(run, "bucket int, part long, a binary, b binary, c binary")


def bucket_words(words: DataFrame) -> DataFrame:
    """bucket, hashes, counts: each word of a bucket once, counts summed over the slices; n, v: their sum and the number of training words."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = (np.concatenate([unpack(x, t) for x in rows[c]]) for c, t in (("a", "<u8"), ("b", "<u4")))
        every, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(every))
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "a": [pack(every)], "b": [pack(total.astype("<f8"))], "n": [float(total.sum())], "v": [float((total > 0).sum())]})

    return words.groupBy("bucket").applyInPandas(merged, "bucket int, a binary, b binary, n double, v double")


def score(docs: DataFrame, train: str = "train") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score. docs: doc_id, text and the boolean column `train`."""
    docs = docs.select("doc_id", F.col(train).alias("train"), "text")
    learning = docs.filter("train")
    size, n_docs, taught = docs.agg(
        F.sum(F.octet_length("text")), F.count(F.when(F.col("train"), 1)), F.sum(F.when(F.col("train"), F.octet_length("text"))),
    ).first()
    size, taught = size or 0, taught or 0
    n_buckets = max(4, -(-size // BUCKET_BYTES))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    model = fit(learning, min(max(SLOTS, 1 << (taught // 32).bit_length()), MOST_SLOTS), cores * max(1, -(-taught // (TASK_BYTES * cores))))
    rows = kept_table(gather(docs, model, n_buckets), "op3-gathered")
    words = rows.filter("bucket >= 0")
    table = kept_table(bucket_words(words), "op3-words")
    found = table.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    big_n, big_v = (found["n"] or 0.0) + n_docs, (found["v"] or 0.0) + (n_docs > 0)

    def answer(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        row = counted.iloc[0]
        hashes, total = unpack(row["a"], "<u8"), unpack(row["b"], "<f8")
        out = [(part, int(row["bucket"]), pack(total[np.searchsorted(hashes, unpack(a, "<u8"))])) for part, a in zip(asked["part"], asked["a"], strict=True)]
        return pd.DataFrame(out, columns=["part", "bucket", "a"])

    answers = words.select("bucket", "part", "a").groupBy("bucket").cogroup(table.select("bucket", "a", "b").groupBy("bucket")).applyInPandas(answer, "part long, bucket int, a binary")
    doc_kind = kind(docs, "doc_id")

    def add_up(slices: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("bucket")
        total = np.concatenate([unpack(x, "<f8") for x in got["a"]]) if len(got) else np.zeros(0)
        row = slices.iloc[0]
        ids = pa.ipc.open_stream(row["a"]).read_pandas()
        word = np.repeat(np.arange(len(total)), unpack(row["b"], "<u4"))
        doc, count = unpack(row["c"], "<u4").reshape(2, -1).astype(np.int64)
        summed = lambda x: np.bincount(doc, weights=count * x, minlength=len(ids))
        tokens = summed(np.ones(len(doc))) + 1
        base = summed(np.log10(total + 0.5)[word]) + np.log10(n_docs + 0.5) - tokens * np.log10(big_n + 0.5 * (big_v + 1))
        known = summed((total > 0)[word].astype(float)) + (n_docs > 0)
        return pd.DataFrame({
            "doc_id": ids["doc_id"], "train": ids["train"], "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": np.int64(big_n),
            "base_score": base, "score": ids["score"],
        })

    schema = f"doc_id {doc_kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.filter("bucket = -1").select("part", "a", "b", "c").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(add_up, schema)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs.withColumn("train", fold(5) != 1))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
