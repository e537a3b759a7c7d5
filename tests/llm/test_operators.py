"""The ten operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from freightloom.llm import bpe, jaccard, language, lm, mixing, repeats, rules, simhash, token_files, viterbi
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, score string, label string, token string"
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    rnd = random.Random(3)
    vocab = {"en": ["the", "and", "of", "thing", "reason", "with"], "de": ["der", "und", "schön", "nicht", "über", "straße"], "fr": ["le", "été", "où", "garçon", "même", "dans"]}
    rare = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(400)]
    make = lambda lang, n: " ".join(rnd.choice(vocab[lang] if rnd.random() < 0.6 else rare) for _ in range(n))
    shared = make("en", 90)
    out = [(make(lang, rnd.randrange(3, 160)), lang) for lang in vocab for _ in range(14)]
    base = make("en", 150).split(" ")
    for k in range(12):  # near copies, each a step further away
        base[k * 7] = f"edit{k}"
        out.append((" ".join(base), "en"))
    out += [(f"{make('de', 30)} {shared} {make('fr', 20)}", None) for _ in range(6)]
    out += [(shared + shared, "en"), ("x" * 3000, "en"), ("ab" * 1500, None), (make("en", 9000), "en")]
    out += [(None, "en"), ("", None), (" \t\n", "en"), ("A", "en"), ("one two", "fr"), ("12 34 --", None), ("  lead  and trail  ", "en"), ("'s it's the <|endoftext|> end  nb\x1csp \U0001f600 é İ", "en")]
    out += [out[0], out[0], out[13], ("Same line\nSame line\n\nother", "en"), ("### spam $$$ " * 60, "en")]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 25, t, lang, "src", 0, "clash", "clash", "clash", "clash", "clash") for i, (t, lang) in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_library_and_round_trips(docs, rows, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    got = by_id(bpe.round_trip(docs, BYTE_BPE))
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = by_id(bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE))
    assert all(again[i]["decoded"] == (t or "") for i, t, *_ in rows)
    assert bpe.round_trip(empty, BYTE_BPE).count() == 0


def test_bpe_forced_cuts_are_never_inside_a_token():
    v = bpe.codec(BYTE_BPE).v
    assert [a for a in [*range(33, 127), *range(128, 192)] if 32 not in v.cuts[a]] == [160]
    assert not any(t[k + 1] in v.cuts[t[k]] for t in v.ids for k in range(len(t) - 1))
    word = "".join(random.Random(1).choice("etaoinshr") for _ in range(300)).encode()  # past the length at which the heap takes over
    assert bpe.merged(word, v) == Tokenizer.from_file(BYTE_BPE).encode(word.decode(), add_special_tokens=False).ids


def test_viterbi_counts_equal_library(docs, rows, empty):
    pieces = list(viterbi.unigram_pieces(PIECES))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
    got = by_id(viterbi.token_counts(docs, PIECES))
    assert all(got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    for t in (" a", "  ", " ", "a ", "a  b", "▁a", "▁", "a▁b", " ▁", "▁ b", "   lead", "trail   "):
        assert sum(map(viterbi.counter(PIECES).__getitem__, viterbi.marked_words(t))) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    assert got[rows[-13][0]]["n_tokens"] >= 0 and viterbi.token_counts(empty, PIECES).count() == 0


def test_viterbi_ties_and_unknowns():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    mine = viterbi.Counter(tuple(pieces))
    for word in ("aaaa", "abab", "aabb", "xyaz", "b", "axxb", ""):
        assert mine.count("▁" + word) == len(library.encode("▁" + word, add_special_tokens=False).ids), word


def test_token_files(spark, docs, rows, empty, tmp_path):
    library = Tokenizer.from_file(WORD_BPE)
    token_files.write(docs, str(tmp_path / "t"), WORD_BPE, files=3)
    read = token_files.read(spark, str(tmp_path / "t"))
    sums, place = by_id(token_files.checksums(read)), by_id(token_files.starts(token_files.read(spark, str(tmp_path / "t"), with_ids=False)))
    at = 0
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (sums[i]["n_tokens"], sums[i]["ids_crc32"], place[i]["start"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), at), t
        at += len(ids)
    assert "ids" not in token_files.read(spark, str(tmp_path / "t"), with_ids=False).columns
    token_files.write(empty, str(tmp_path / "e"), WORD_BPE, files=2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_token_files_pieces_keep_the_ids():
    """Every kind of cut and white space: the ids of the pieces one after another are those of the whole text."""
    library, known = Tokenizer.from_file(WORD_BPE), token_files.WordIds(WORD_BPE)
    texts = [
        "", " ", "A\x01b \x01 \x01\x01 c", "A\x1cB c\x85d\u3000e\u00a0f", "<|endoftext|> HELLO<|startoftext|>x.y", "I'm we'RE 'r5 '.s ',s don't. (e.g., 12.5%)",
        "a\u0301, .\u0301a 1\u0301 =\u0338b a.\u0301", "\u00dcber, Stra\u00dfe. \u0130STANBUL \u01c5", "x" * 3000 + ".,;" * 500 + "\u00e9" * 900, "item12b-c_d/e@f",
    ]
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
    words = token_files.split(np.frombuffer(b"".join(coded), np.uint8), offsets).to_pylist()
    known.learn({w for row in words for w in row})
    for t, row in zip(texts, words, strict=True):
        assert np.frombuffer(b"".join(known[w] for w in row), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_language_id(docs, rows, empty):
    got = by_id(language.identify(docs, language.prototypes(docs)))
    for i, t, lang, *_ in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
        if lang and letters and len(t) > 150 and len(set(t)) > 8:
            assert got[i]["lang_pred"] == lang
    assert language.prototypes(empty) == {}
    assert set(r["lang_pred"] for r in language.identify(docs, {}).collect()) == {"und"}


def components_by_force(items):
    sets = []
    for _, t in items:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {items[k][0]: (len(sets[k]), items[find(k)][0]) for k in range(len(items))}


@pytest.mark.parametrize("often", [8, 2, 10**9])
def test_jaccard_join(docs, rows, empty, often, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    want = components_by_force([(r[0], r[1]) for r in rows])
    got = jaccard.linked(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    if often == 8:
        assert jaccard.linked(empty).count() == 0
        kept = jaccard.one_of_each(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats(docs, rows, empty, crowd):
    count = collections.Counter(b[k : k + 400] for _, t, *_ in rows for b in [(t or "").encode()] for k in range(len(b) - 399))
    got = {r["doc_id"]: r["_repeats_spans"] or [] for r in repeats.with_spans(docs, crowd=crowd).select("doc_id", "_repeats_spans").collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        want = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                want[k : k + 400] = True
        mine = np.zeros(len(b), bool)
        for s in got[i]:
            mine[s["a"] : s["b"]] = True
        assert (want == mine).all(), i
    assert repeats.remove_repeats(empty).count() == 0


def test_short_borders_by_force():
    rnd = random.Random(5)
    data = "".join(rnd.choice("ab") for _ in range(300)) * 2 + "abc" * 30
    order, border = repeats.short_borders(np.frombuffer(data.encode(), np.uint8).astype(np.uint64) + np.uint64(1), 25)
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :], data[order[k] :]
        assert border[k] == (a[:25] != b[:25]) or min(len(a), len(b)) < 25


def test_simhash(spark, docs, rows, empty):
    pairs = by_id(simhash.with_next(docs, 4))
    for k, r in enumerate(rows):
        assert pairs[r[0]]["next_text"] == (rows[(k + 1) % len(rows)][1] or "")
    fps = by_id(simhash.fingerprints(docs, ["doc_id"]))
    by_text = collections.defaultdict(set)
    for i, t, *_ in rows:
        by_text[t or ""].add(fps[i]["fp"])
    assert all(len(v) == 1 for v in by_text.values()) and fps[rows[-13][0]]["fp"] == 0
    table = [r["fp"] for r in fps.values()]
    rnd = random.Random(2)
    table += [x ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for x in table]
    frame = spark.createDataFrame([(x,) for x in table], "fp long")
    got = {(r["q"], r["fp"]) for r in simhash.neighbours(frame.withColumnRenamed("fp", "q"), frame, 3).collect()}
    assert got == {(a, b) for a in set(table) for b in set(table) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert simhash.with_next(empty, 4).count() == 0 and simhash.fingerprints(empty, ["doc_id"]).count() == 0


def test_rule_statistics(docs, rows, empty):
    got = by_id(rules.statistics(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
    assert rules.statistics(empty).count() == 0


def test_rules_learn_a_planted_rule(spark):
    rnd = random.Random(4)
    good = [(i, rnd.random() * 0.2, rnd.random(), 0) for i in range(600)]
    bad = [(600 + i, 0.5 + rnd.random(), rnd.random(), 1) for i in range(200)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, x double, y double, bad int")
    learned = rules.learn(df, ["x", "y"])
    kept = {r["doc_id"] for r in df.filter(rules.decide(learned)).collect()}
    assert learned and kept == set(range(600))
    assert rules.learn(df.limit(0), ["x", "y"]) == [] and rules.learn(df.filter("bad = 0"), ["x", "y"]) == []


def test_bpe_workers_forget_and_language_needs_little_memory():
    """What a stage remembers does not stay in a worker that later stages use; a slice of texts with many letters takes no table of all their triples."""
    codec = bpe.Codec(BYTE_BPE)
    before = codec.encode("some words and some more words")
    assert codec.rest and codec.rest.words
    codec.forget()
    assert not (codec.first or codec.first.words or codec.rest or codec.rest.words) and codec.encode("some words and some more words") == before
    data = "".join(chr(0x4E00 + i) for i in range(200)).encode()
    tracemalloc.start()
    counts, vectors, _ = language.trigram_counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 200 and len(vectors) == 200 and most < 50 << 20


def test_lm_base_and_score(docs, rows, empty):
    got = by_id(lm.score(docs.withColumn("train", F.col("doc_id") % 75 != 0)))
    counts, total, n_docs = collections.Counter(), 0, 0
    for i, t, *_ in rows:
        if i % 75:
            counts.update(WORD.findall(lower(t or "")))
            n_docs += 1
    total, types = sum(counts.values()) + n_docs, len(counts) + 1
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        base = sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w) + np.log10((n_docs + 0.5) / (total + 0.5 * (types + 1)))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert abs(got[i]["base_score"] - base) < 1e-6 and got[i]["score"] < 0
    assert lm.score(empty.withColumn("train", F.lit(True))).count() == 0


def test_lm_spelling_is_a_probability():
    """Over all one-letter continuations the bits' probabilities add up to one."""
    sizes = np.ones(256, np.int64)
    chars = np.arange(256, dtype=np.uint8)
    counts = np.random.default_rng(1).integers(0, 5, (lm.PREDICTORS, lm.SLOTS, 2)).astype(np.float32)
    model = lm.Model(counts)
    bits = lm.Bits(chars, sizes)
    bits.word = np.repeat(np.arange(512), 8)
    assert abs((10.0 ** model.word_scores(bits, 512)[::2]).sum() - 1) < 1e-9


def test_lm_mixes_the_bits_of_known_words_across_words(spark):
    """Known words cost less in an order that was learned than in another, and probabilities of all next bytes add to one after any words."""
    rows = [(i, "red fox jumps over lazy dog", True) for i in range(60)] + [(100, "red fox jumps over lazy dog", False), (101, "dog over red lazy jumps fox", False)]
    got = by_id(lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")))
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 3
    model = lm.Model(np.random.default_rng(2).integers(0, 9, (lm.PREDICTORS, lm.SLOTS, 2)).astype(np.uint16))
    before = np.frombuffer(b"red fox j", np.uint8)
    keys = lm.keys_of(np.concatenate([np.append(before, np.uint8(c)) for c in range(256)]), np.full(256, len(before) + 1))
    last = keys.reshape(256, -1)[:, len(before)]
    assert abs((10.0 ** model.word_scores(lm.Bits.of(last, lm.SLOTS), 256)).sum() - 1) < 1e-9
    chars, sizes = lm.stream_of(before, np.array([0, 4, 9]))
    assert np.allclose(model.row_scores(chars, sizes), model.word_scores(lm.Bits(chars, sizes), 2))


def test_lm_long_words_cost_all_their_bytes(spark):
    """An unseen run without spaces is spelled to its end: twice the bytes, about twice the cost, and never dearer prose."""
    rnd = random.Random(4)
    blob = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    prose = [" ".join(rnd.choice(["reason", "matter", "winter", "answer", "thing"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", True) for i, t in enumerate(prose)] + [(100 + n, blob[:n], None, False) for n in (100, 1_000, 10_000, 20_000)] + [(99, prose[0], "en", False)]
    got = by_id(lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")))
    cost = {n: -got[100 + n]["score"] for n in (100, 1_000, 10_000, 20_000)}
    assert cost[1_000] > 5 * cost[100] and cost[10_000] > 9 * cost[1_000] and 1.9 < cost[20_000] / cost[10_000] < 2.1
    assert cost[20_000] > 20_000 and cost[1_000] > -got[99]["score"]


def test_mixing(spark, docs, rows, empty):
    rnd = random.Random(6)
    q = [[0.9, 0.1] if rnd.random() < 0.7 else [0.2, 0.8] for _ in range(400)]
    table = spark.createDataFrame([(i, 10 + i % 7, x) for i, x in enumerate(q)], "doc_id long, n_tokens long, q array<double>")
    rated = mixing.with_rates(table, mixing.solve(table, np.array([0.5, 0.5])), 2).collect()
    total = sum(r["n_tokens"] for r in rated)
    shares = [sum(r["n_tokens"] * r["rate"] * r["q"][k] for r in rated) / total for k in (0, 1)]
    assert all(abs(s - 0.5) < 0.02 for s in shares) and min(r["rate"] for r in rated) >= 0
    labels = spark.createDataFrame([(r[0], int("spam" not in (r[1] or "")), 0) for r in rows] + [(None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix_to_targets(docs, labels)
    assert out.count() == len(rows) and out.filter("rate < 0 or rate is null").count() == 0
    assert mixing.mix_to_targets(docs, labels.limit(0)).count() == len(rows)
    assert mixing.mix_to_targets(empty, labels).count() == 0


def test_mixing_rare_domain_gets_near_its_target(spark):
    """A domain with target 0 goes, however few tokens it has."""
    for rare in (20, 2):
        q = [[0.0, 0.0, 1.0] if i < rare else [0.0, 1.0, 0.0] if i % 9 == 0 else [1.0, 0.0, 0.0] for i in range(2000)]
        table = spark.createDataFrame([(i, 100, x) for i, x in enumerate(q)], "doc_id long, n_tokens long, q array<double>")
        solution = mixing.solve(table, np.array([0.95, 0.05, 0.0]))
        rated = mixing.with_rates(table, solution, 3).collect()
        assert all(r["rate"] < 0.01 for r in rated if r["doc_id"] < rare)
        assert np.abs(solution.reached - [0.95, 0.05, 0.0]).max() < 1e-3 and not solution.missed(["high", "low", "toxic"])


def test_mixing_settles_on_the_least_squares_solution(spark, monkeypatch):
    """With soft posteriors and the rates written down between, the steps end where no gradient is left, or at a bound."""
    rnd = np.random.default_rng(8)
    q = np.concatenate([rnd.dirichlet([6, 1, 0.3], 300), rnd.dirichlet([1, 3, 0.3], 60), rnd.dirichlet([0.5, 0.5, 2], 8)])
    t, targets = rnd.integers(1, 400, len(q)), np.array([0.95, 0.05, 0.0])
    table = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, q, strict=True))], "doc_id long, n_tokens long, q array<double>")
    monkeypatch.setattr(mixing, "AT_ONCE", 4)
    for once in (False, True):
        solution = mixing.solve(table, targets, once=once)
        r = np.array([x["rate"] for x in mixing.with_rates(table, solution, 3).orderBy("doc_id").collect()])
        w, x = t / t.sum(), q - targets if once else q
        slope = x @ (((w * r) @ x - (0 if once else targets)) / (w @ q)) + 0.004 * (r - 1)
        stuck = np.abs(r - np.clip(r - slope, 0, 1 if once else None))
        assert len(solution.steps) > 8 and stuck.max() < 1e-3, (once, len(solution.steps), stuck.max())


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"word{k}" for k in range(200))
    df = spark.createDataFrame([(None, long, "en"), (None, None, None), (5, long, "en"), (5, long, "en"), (7, "a b", None)], "doc_id long, text string, lang string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.linked(df).collect())
    assert got == {(None, 5): 1, (None, None): 1, (5, 5): 2, (7, 7): 1}
    assert sum(r["_repeats_spans"] is not None for r in repeats.with_spans(df).collect()) == 3
    assert simhash.with_next(df, 3).count() == 5 and rules.statistics(df).count() == 5
    assert bpe.round_trip(df, BYTE_BPE).count() == 5 and language.identify(df, language.prototypes(df)).count() == 5
    assert lm.score(df.withColumn("train", F.lit(True))).count() == 5


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size, changed in ((0, 0), (3, 1), (200, 9), (200, 200), (5000, 40)):
        first = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        second = np.unique(np.concatenate([first[changed:], rng.integers(0, 2**64, changed, dtype=np.uint64)]))
        h, r = np.concatenate([first, second]), np.repeat([0, 1], [len(first), len(second)])
        a, b = (np.array(x, np.int64) for x in jaccard._parity(h, r, 2).to_pylist())
        flipped = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        differ = len(np.setxor1d(first, second))
        assert flipped <= differ and (flipped - differ) % 2 == 0
        assert len(a) == jaccard.PARITY // 64


def test_components_extended_by_links(spark):
    label = jaccard.extended(None, spark.createDataFrame([(1, 2), (3, 2), (7, 8), (20, 21)], "a long, b long"))
    got = jaccard.extended(label, spark.createDataFrame([(8, 3), (9, 10), (21, 20), (10, 11)], "a long, b long")).collect()
    assert sorted((r["node"], r["label"]) for r in got) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (9, 9), (10, 9), (11, 9), (20, 20), (21, 20)]


def test_helper_columns_do_not_clash(spark):
    """Callers' columns named like helpers stay as they are."""
    passage = " ".join(f"word{k}" for k in range(90))
    rows = [(k, f"{k} start of text {passage} end {k}", "mine", "mine", "mine", "mine", "mine", "mine") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _th string, _spans string, _keep string, spans string, start string")
    out = repeats.remove_repeats(df)
    assert out.columns == df.columns and all(set(r[2:]) == {"mine"} and "word40" not in r["text"] for r in out.collect())
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.collect()] == [("mine",) * 6]


def test_one_doc_id_with_two_texts_keeps_both(spark):
    texts = ["one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0])], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.one_of_each(df).collect()) == sorted([(1, texts[0]), (1, texts[1])])
