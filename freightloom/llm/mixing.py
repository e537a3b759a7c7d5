"""Mixing documents to target weights with soft domains.

A table of labels names domains (toxic; else high or low by quality). A multinomial logistic regression on marker words and character rates
gives every document its domain posteriors q. Documents get rates r >= 0 so that the expected tokens of each domain, sum of r * tokens * q,
come close to the target weights times all tokens: least squares of the errors relative to the domains' shares with a small pull to rate 1, solved
by accelerated projected gradient steps until they settle in every domain, so a rare domain gets as near its target as a frequent one. Targets missed
by more than 2% are logged. With `once` rates end at 1 and the targets are shares of the kept tokens.
A step needs one vector of sums over the documents; the state of a document is its row, its rate follows from the sums of the steps so far.

The classifier is fitted on about `labelled` rows, chosen by a hash of doc_id (a documented bound: the rows are broadcast as ids only).
Null text: no tokens, posteriors of an empty text, weight 0 in all sums. Labels with a null in quality and toxic are not used. A document labelled twice
is learned from twice. Without labels there is one domain. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import LOWER, documents, kept_table, kind, prefix_hash, substring_hash, text_chunks, words_of

TARGETS = {"high": 0.95, "low": 0.05, "toxic": 0.0}
LABELLED = 20_000
AT_ONCE = 25  # steps replayed per pass before the rates are written down
MARKERS = 200  # marker words of each domain
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KINDS = [frozenset(b"#*$%&|<>"), frozenset(b"!?"), frozenset(range(65, 91)), frozenset(range(48, 58)), frozenset(b"\n")]
KIND = np.zeros((len(_KINDS), 256), bool)
for _k, _bytes in enumerate(_KINDS):
    KIND[_k, list(_bytes)] = True


def domain(labels: DataFrame) -> DataFrame:
    """doc_id, domain."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", name.alias("domain")).filter("domain is not null and doc_id is not null")


def _letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    start, end, row = words_of(low, offsets, NOT_LETTER)
    return substring_hash(prefix_hash(low), start, end).view(np.int64), row


def _rates(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character rates of each row, and its number of white-space words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = []
    for k in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum(KIND[k][data])])
        out.append(np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / size))
    tokens = np.bincount(words_of(data, offsets)[2], minlength=n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=n)
    words = np.bincount(row, minlength=n)
    out += [distinct / np.maximum(words, 1), np.log1p(words) / 10, size / np.maximum(tokens, 1) / 20]
    return np.stack(out, axis=1), tokens


def _features(data: np.ndarray, offsets: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, row = _letter_words(data, offsets)
    rates, tokens = _rates(data, offsets, hashes, row)
    x = np.zeros((len(offsets) - 1, len(markers)))
    if len(markers):
        at = np.minimum(np.searchsorted(markers, hashes), len(markers) - 1)
        hit = markers[at] == hashes
        x[row[hit], at[hit]] = 1
    return np.concatenate([x, rates], axis=1), tokens


class Classifier:
    def __init__(self, names: list[str], markers: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.names, self.markers, self.weights, self.bias = names, markers, weights, bias

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, tokens = _features(data, offsets, self.markers)
        z = x @ self.weights.T + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), tokens


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Classifier:
    named = domain(labels)
    total = named.count()
    share = min(1.0, labelled / max(total, 1))
    chosen = named.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches):
            hashes, row = _letter_words(data, offsets)
            each = [np.unique(x) for x in np.split(hashes, np.searchsorted(row, np.arange(1, part.num_rows)))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("domain"), part.column("text"), pa.ListArray.from_arrays(ends, np.concatenate(each))], ["domain", "text", "words"])

    kept = kept_table(sample.mapInArrow(words, "domain string, text string, words array<long>"), "op1-sample")
    sizes = {r["domain"]: r["n"] for r in kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return Classifier(names or ["all"], np.zeros(0, np.int64), np.zeros((1, len(_KINDS) + 3)), np.zeros(1))
    counts = kept.select("domain", F.explode("words").alias("w")).groupBy("w").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(names)])
    everything, rows = sum(sizes.values()), []
    for i, d in enumerate(names):
        others = sum((F.col(f"n{j}") for j in range(len(names)) if j != i), F.lit(0))
        a, b = (F.col(f"n{i}") + 0.5) / (sizes[d] + 1), (others + 0.5) / (everything - sizes[d] + 1)
        rows += counts.filter(F.col(f"n{i}") + others >= 5).select("w", ((a - b) * F.log(a / b) * F.signum(a - b)).alias("s")).orderBy(F.desc("s"), "w").limit(MARKERS).collect()
    markers = np.array(sorted({r["w"] for r in rows}), np.int64)
    width = len(markers) + len(_KINDS) + 3

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches):
            x, _ = _features(data, offsets, markers)
            ends = np.arange(len(x) + 1, dtype=np.int32) * width
            label = pa.array([float(names.index(d)) for d in part.column("domain").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([label, pa.ListArray.from_arrays(ends, x.ravel())], ["label", "x"])

    table = kept_table(kept.select("domain", "text").mapInArrow(vectors, "label double, x array<double>"), "op1-vectors")
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40).fit(table.select("label", array_to_vector("x").alias("features")))
    return Classifier(names, markers, model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens, q (array of the domains' posteriors in the order of model.names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches):
            q, tokens = model.posteriors(data, offsets)
            ends = np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(ends, q.ravel())], ["doc_id", "n_tokens", "q"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, n_tokens long, q array<double>")


@dataclass
class Solution:
    """Projected gradient steps that turn rates of 1 into the solution, and what they reach. steps: the errors over the domains' shares."""

    targets: np.ndarray
    once: bool  # rates at most 1, targets are shares of the kept tokens
    pull: float
    bend: float = 1.0  # the gradient's largest slope
    steps: list[np.ndarray] = field(default_factory=list)
    shares: np.ndarray | None = None  # the domains' share of all tokens before
    reached: np.ndarray | None = None  # and what stands against the targets after

    def seen(self, q: np.ndarray) -> np.ndarray:
        """What a document's tokens add to the domains' errors; without `once` the targets are taken off afterwards."""
        return q - self.targets if self.once else q

    def advance(self, q: np.ndarray, r: np.ndarray, y: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rates after the steps from `done` on, the point the next step starts from, and how far the last step moved."""
        x, moved = self.seen(q), np.zeros(len(r))
        root = np.sqrt(self.pull / self.bend)
        for n in range(done, len(self.steps)):
            last, r = r, np.clip(y - (x @ self.steps[n] + self.pull * (y - 1)) / self.bend, 0.0, 1.0 if self.once else None)
            moved = np.abs(r - y)
            y = r + min(n / (n + 3), (1 - root) / (1 + root)) * (r - last)
        return r, y, moved

    def missed(self, names: list[str]) -> list[str]:
        """The domains whose share is off the target by more than 2% of the target, or of the share before if that is more."""
        if self.reached is None:
            return []
        return [
            f"{n}: {x:.5f} for {t:.5f}" for n, x, t, s in zip(names, self.reached, self.targets, self.shares, strict=True) if abs(x - t) > 0.02 * max(t, s)
        ]


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q, t = b.column("q").flatten().to_numpy().reshape(-1, k), b.column("n_tokens").to_numpy(zero_copy_only=False)
    r, y = (b.column(c).to_numpy() if c in b.schema.names else np.ones(len(t)) for c in ("r", "y"))
    return q, t, r, y


def _added(table: DataFrame, width: int, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum((sums(b) for b in batches), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in out], [f"s{i}" for i in range(width)])

    found = table.mapInArrow(run, ", ".join(f"s{i} double" for i in range(width))).agg(*[F.sum(f"s{i}") for i in range(width)]).first()
    return np.array([v or 0.0 for v in found])


def solve(table: DataFrame, targets: np.ndarray, pull: float = 0.004, once: bool = False, tolerance: float = 1e-5, most: int = 2_000) -> Solution:
    """Accelerated projected gradient steps until none moves the rates of any domain by more than `tolerance` in the mean of its tokens (`with_rates`
    applies them). Each domain's error, and so the pull, counts relative to its share of the tokens. targets: the domains' share of all tokens, or with
    `once` of the tokens kept at rates of at most 1. Steps that do not settle raise an error."""
    k = len(targets)
    found = _added(table.select("n_tokens", "q"), k + k * k + 1, lambda b: _first_sums(b, k))
    out, total = Solution(targets, once, pull), found[-1]
    if not total:
        return out
    share, gram = found[:k] / total, found[k:-1].reshape(k, k) / total
    out.shares = share
    weight = np.divide(1.0, share, out=np.zeros(k), where=share > 0)
    if once:
        gram = gram - np.outer(share, targets) - np.outer(targets, share) + np.outer(targets, targets)
    out.bend = float(np.linalg.eigvalsh(gram * np.sqrt(np.outer(weight, weight)))[-1]) + pull
    state, done = table.select("n_tokens", "q"), 0

    def sums(b: pa.RecordBatch) -> np.ndarray:
        q, t, r, y = _columns(b, k)
        r, y, moved = out.advance(q, r, y, done)
        return np.concatenate([(y * t) @ out.seen(q), (r * t) @ q, (moved * t) @ q])

    while True:
        error, kept, moved = _added(state, 3 * k, sums).reshape(3, k) / total
        if out.steps and (moved * weight).max() < tolerance:
            out.reached = kept / max(kept.sum(), 1e-300) if once else kept
            return out
        if len(out.steps) >= most:
            raise ArithmeticError(f"rates still move by {(moved * weight).max():.2g} after {most} steps")
        if len(out.steps) - done >= AT_ONCE:
            state, done = kept_table(_advanced(state, out, done, k), "op1-state"), len(out.steps)
        out.steps.append((error if once else error - targets) * weight)


def _first_sums(b: pa.RecordBatch, k: int) -> np.ndarray:
    q, t, _, _ = _columns(b, k)
    return np.concatenate([t @ q, ((q * t[:, None]).T @ q).ravel(), [t.sum()]])


def _advanced(state: DataFrame, solution: Solution, done: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, _, r, y = _columns(b, k)
            r, y, _ = solution.advance(q, r, y, done)
            yield pa.RecordBatch.from_arrays([b.column("n_tokens"), b.column("q"), pa.array(r), pa.array(y)], ["n_tokens", "q", "r", "y"])

    return state.mapInArrow(run, "n_tokens long, q array<double>, r double, y double")


def with_rates(table: DataFrame, solution: Solution, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, _, r, y = _columns(b, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(solution.advance(q, r, y, 0)[0], pa.float64())], [*b.schema.names, "rate"])

    return table.mapInArrow(run, f"doc_id {kind(table, 'doc_id')}, n_tokens long, q array<double>, rate double")


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, once: bool = False) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, rate, copies (the rate rounded up or down by a fixed draw, so that its mean is the rate).
    Targets that are not met are logged. once: see `solve`."""
    targets = TARGETS if targets is None else targets
    model = fit(docs, labels)
    table = kept_table(posteriors(docs, model), "op1")
    wanted = np.array([targets.get(n, 1.0 if model.names == ["all"] else 0.0) for n in model.names])
    solution = solve(table, wanted, once=once)
    if missed := solution.missed(model.names):
        logging.getLogger(__name__).warning("token shares off their targets: %s", ", ".join(missed))
    rated = with_rates(table, solution, len(model.names))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000.0
    return rated.select(
        "doc_id", "n_tokens", *[F.col("q")[i].alias(f"p_{n}") for i, n in enumerate(model.names)], "rate", F.floor(F.col("rate") + draw).cast("long").alias("copies"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
