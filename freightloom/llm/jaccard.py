"""N-gram Jaccard join: classes of documents linked by a similarity of 0.8 or more of their sets of five-word shingles.

1. Equal sets become one, represented by their smallest doc_id.
2. All shingles have one order: by hash, except that shingles seen often (the `FREQUENT` most seen ones, counted over all
   documents) come last, the most seen at the very end. Any order gives the same result; this one keeps the index lists short. Two sets with the similarity share
   a shingle in their prefixes of n - ceil(0.8 n) + 1, and at the first shared one their positions add up to (n + m) / 9 at most.
3. An index list (the sets that have a shingle in their prefix, with sizes and positions) is cut in two blocks, head (position up to n / 9)
   and tail. Pairs within the tail cannot meet the position bound, so the tail block is never joined with itself.
4. In a few turns each list has one head set as its centre, and each set is compared with the centre it meets most often, if that is in another
   component. Links join sets to components. For the other pairs of a list the
   answers follow from the first turn's: with overlaps a and b to the star's centre, sets of sizes n and m have at least a + b - |centre| and at most
   min(a, b) + min(n - a, m - b) shingles in common. What that decides is not compared, nor are pairs already in one component.
   Each set also has PARITY bits, each telling whether an odd number of its shingles fall on it. A shingle of one of two sets only flips one bit,
   so the sets differ in as many shingles as bits at least; with more than (n + m) / 9 they are no link and the list's join does not emit the pair.
5. The rest is compared, and the components are completed. Pairs within a component are never all made.

Shingle hashes have 64 bits; overlaps are counted between the two sets' hashes. Words are lower-cased in A-Z and cut at ASCII white space.
Null or empty text, or one without words: an empty set, linked with nothing. Rows with one doc_id count as one document for links.
Null doc_ids link by the set they have but represent nothing: a class with null ids only has a null component_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import LOWER, documents, kept_table, mix, prefix_hash, shingles_of, substring_hash, text_chunks, words_of
from freightloom.session import checkpoint

FREQUENT = 1 << 18
OFTEN = 8
WINDOW = 2_000_000
PARITY = 512
SLICE = 1 << 20  # text bytes turned into sets at once


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending in a row, and their rows."""
    low = LOWER[data]
    start, end, row = words_of(low, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = shingles_of(substring_hash(prefix_hash(low), start, end), row, len(offsets) - 1)
    by = np.lexsort((h, r))
    h, r = h[by], r[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _signatures(h: np.ndarray, r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal sets have equal ones."""
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))])
        ends = np.searchsorted(r, np.arange(rows + 1))
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def _parity(h: np.ndarray, r: np.ndarray, rows: int) -> pa.ListArray:
    """PARITY bits of each row's set, as 64-bit integers: whether an odd number of its shingles fall on the bit."""
    bit = (mix(h ^ np.uint64(0x2F9E3C51)) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(r * PARITY + bit, minlength=rows * PARITY) & 1).astype(np.uint8)
    words = PARITY // 64
    return pa.ListArray.from_arrays(np.arange(0, words * rows + 1, words, dtype=np.int32), pa.array(np.packbits(odd).view(np.int64)))


def _seen_together(docs: DataFrame) -> DataFrame:
    """token, n: shingles that a task saw in three different sets of a window of WINDOW shingles; of any place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            keep = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "n"])

        for part, data, offsets in text_chunks(batches, SLICE):
            h, r = sets_of(data, offsets)
            fresh = np.zeros(part.num_rows, bool)
            for k, (a, b) in enumerate(zip(*[x.tolist() for x in _signatures(h, r, part.num_rows)], strict=True)):
                if (a << 64) ^ b not in seen:
                    seen.add((a << 64) ^ b)
                    fresh[k] = True
            held.append(h[fresh[r]])
            size += len(held[-1])
            if size >= WINDOW:
                yield out()
                held, seen, size = [], set(), 0
        yield out()

    return docs.select("text").mapInArrow(run, "token long, n long")


def _prefix_size(n: np.ndarray, share: float) -> np.ndarray:
    return np.where(n > 0, np.minimum(n, (share * (n - (4 * n + 4) // 5 + 1)).astype(np.int64)), 0)


def _early(docs: DataFrame, share: float) -> DataFrame:
    """token: the shingles that stand first by hash in each document, `share` times a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, SLICE):
            h, r = sets_of(data, offsets)
            n = np.bincount(r, minlength=part.num_rows)
            keep = np.arange(len(h)) - (np.cumsum(n) - n)[r] < _prefix_size(n, share)[r]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64))], ["token"])

    return docs.select("text").mapInArrow(run, "token long")


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The shingles seen most often, rarest first.

    Two counts: exact ones of those that stand first by hash in a document (half as many again as a prefix has), and, for the rest, sums
    over windows. What both miss costs time, never a link.
    """
    early = _early(docs, 1.5)
    exact = early.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    near = _seen_together(docs).groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = exact.unionByName(near).groupBy("token").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    return rows.column("token").to_numpy()[::-1].copy().view(np.uint64)


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, s1, s2 (signature of the set), bits (of parity), prefix."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, SLICE):
            h, r = sets_of(data, offsets)
            n = np.bincount(r, minlength=part.num_rows)
            s1, s2 = _signatures(h, r, part.num_rows)
            bits = _parity(h, r, part.num_rows)
            late = np.zeros(len(h), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                late = np.where(values[at] == h, by_value[at] + 1, 0)
                by = np.lexsort((h, late, r))
                h, r = h[by], r[by]
            place = np.arange(len(h)) - (np.cumsum(n) - n)[r]
            size = _prefix_size(n, 1.0)
            keep = place < size[r]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), bits, pa.ListArray.from_arrays(ends, pa.array(h[keep].view(np.int64)))],
                ["doc_id", "n", "s1", "s2", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, bits array<long>, prefix array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep, n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, SLICE):
            h, r = sets_of(data, offsets)
            n = np.bincount(r, minlength=part.num_rows)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], ["rep", "n", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, n int, shingles array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, both: the compared pairs."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    return joined.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))


def promising(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough of their prefixes. held: rep, n, tokens (the prefix shingles that other sets have as well).

    Take the set whose prefix ends first: shared shingles up to that end are in both prefixes, later ones among its n - prefix others.
    """
    side = lambda x: held.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    later = F.expr("greatest(int((4 * na + 4) / 5), int((4 * nb + 4) / 5)) - 1")
    return joined.filter(9 * (shared + later) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): for each set b the centre a it meets in most lists, of another component. Each list has one centre, a head set drawn anew each turn."""
    centre = rows.filter("9 * pos <= n").groupBy("token").agg(F.min(F.struct((F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")).alias("draw"), "rep", "n", "pos", "label")).alias("x"))
    centre = centre.select("token", F.col("x.rep").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("pa"), F.col("x.label").alias("la"))
    met = rows.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "label").join(kept_table(centre, "op5-centre"), "token")
    met = met.filter(f"label <> la and {SIZES} and {PLACES}").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")


def _sets_for(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = kept_table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "op5-wanted")
    return kept_table(full_sets(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")), "op5-sets")


LINKED = "100 * both >= 80 * (na + nb - both)"
SIZES = "5 * least(na, nb) >= 4 * greatest(na, nb)"
PLACES = "9 * (pa + pb) <= na + nb"
FLIPS = "9 * (" + " + ".join(f"bit_count(xa[{k}] ^ xb[{k}])" for k in range(PARITY // 64)) + ") <= na + nb"


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node each node of the edges (a, b) is connected with.

    Rounds of two steps: every node's larger, then smaller neighbours move to its smallest neighbour, until all edges are stars.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = checkpoint(edges)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def extended(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label of the links (a, b) and those that `label` already stands for: only the links between its components are followed anew."""
    if label is None:
        return components(links)
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = label.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(more.join(label, "node", "left_anti").select("node", "label"))


def linked(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id. rounds: how often stars are compared before pairs are."""
    heads = kept_table(prefixes(docs, frequent_shingles(docs)), "op5-prefix")
    classes = heads.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = kept_table(classes, "op5-classes")
    first = classes.filter("rep is not null").select(F.col("rep").alias("doc_id"), "n", "s1", "s2")
    index = heads.join(first, ["doc_id", "n", "s1", "s2"], "left_semi").select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "token"))
    # Lists with two sets at least. Most shingles are in one set only: they are told by a count, so each row is dealt by its shingle once.
    again = kept_table(index.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token"), "op5-again")
    shared = kept_table(index.join(again, "token"), "op5-shared")
    held = kept_table(shared.groupBy("rep", "n").agg(F.collect_list("token").alias("tokens")), "op5-held")
    rows, label, known = shared.withColumn("label", F.col("rep")), None, None
    for k in range(rounds):
        pairs = kept_table(promising(_stars(rows, k), held), "op5-star")
        answers = kept_table(overlaps(pairs, _sets_for(docs, pairs)), "op5-answers")
        found = answers.filter(LINKED).select("a", "b")
        known = answers if known is None else known
        if k and not found.limit(1).count():
            break
        label = kept_table(extended(label, found), "op5-labels")
        # Lists in which components are still to be told apart.
        now = shared.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        mixed = now.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
        rows = kept_table(now.join(kept_table(mixed, "op5-mixed"), "token"), "op5-open")
    # All pairs of a list in different components, but for those that follow from the overlaps with a common centre.
    centred = known.select(F.col("b").alias("rep"), F.col("a").alias("c"), F.col("na").alias("nc"), F.col("both").alias("o"))
    bits = heads.join(first, ["doc_id", "n", "s1", "s2"], "left_semi").groupBy(F.col("doc_id").alias("rep"))
    # A doc_id repeated with different texts has several sets: no bits, so nothing is told from them.
    bits = bits.agg(F.when(F.min("s1") == F.max("s1"), F.first("bits")).alias("bits"))
    rows = rows.select("token", "rep", "n", "pos", "label").join(centred, "rep", "left").join(bits, "rep")
    left = rows.filter("9 * pos <= n").select("token", *[F.col(x).alias(y) for x, y in (("rep", "a"), ("n", "na"), ("pos", "pa"), ("o", "oa"), ("label", "la"), ("c", "ca"), ("bits", "xa"))])
    right = rows.select("token", *[F.col(x).alias(y) for x, y in (("rep", "b"), ("n", "nb"), ("pos", "pb"), ("o", "ob"), ("label", "lb"), ("c", "cb"), ("nc", "nc"), ("bits", "xb"))])
    most = "least(oa, ob) + least(na - oa, nb - ob)"
    once = "(a < b or 9 * pb > nb)"
    open_pairs = left.join(right, "token").filter(f"la <> lb and {once} and {SIZES} and {PLACES} and coalesce({FLIPS}, true) and (ca is null or cb is null or ca <> cb or 9 * ({most}) >= 4 * (na + nb))")
    open_pairs = open_pairs.select("a", "b", F.expr("coalesce(ca = cb and 9 * (oa + ob - nc) >= 4 * (na + nb), false)").alias("sure")).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    open_pairs = kept_table(open_pairs, "op5-open-pairs")
    unsure = kept_table(promising(open_pairs.filter("not sure"), held), "op5-unsure")
    rest = overlaps(unsure, _sets_for(docs, unsure)).filter(LINKED)
    links = open_pairs.filter("sure").select("a", "b").unionByName(rest.select("a", "b"))
    final = kept_table(extended(label, links), "op5-labels")
    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component_id"))
    out = heads.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id. Rows with a null doc_id stay, repeated rows stay once; of rows with one doc_id
    and different texts all texts stay if the document does. doc_id has to be an integer."""
    keep = linked(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    named = docs.filter("doc_id is not null").join(keep, F.col("doc_id") == F.col("__kept_id"), "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))
