"""The filter audit, byte-level BPE and phrase collocations against brute force on small tables."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from freightloom.llm import audit, byte_bpe, collocations
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, part string, cell string, ids string, starts string, block string, h string, phrase string, n string, digest string"
CLASH = ("clash",) * 9


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    rnd = random.Random(11)
    vocab = ["the", "of", "Straße", "été", "new", "york", "city", "a", "i\x0bx", "X1", "don't", "日本語", "\U0001f600"] + ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(60)]
    marks = [" "] * 14 + [". ", ", ", "\n", "  ", "\t", "!? ", " ; ", "\r\n"]
    make = lambda n: "".join(rnd.choice(vocab) + rnd.choice(marks) for _ in range(n))
    out = [make(rnd.choice([3, 40, 220, 400])) for _ in range(60)]
    out += ["New York City " * 300, "of the of the the the, the the. " * 40, "ABC DEF " * 210, "x" * 4000, "long text " * 40000, "$ # money", make(260) + "#"]
    out += [None, "", "", " \t\n", "word", "<|endoftext|> 's 're　\xa0 \x85\x1c end  ", out[0], out[0], out[3], out[61]]
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(i * 3 % 101, t, rnd.choice(["en", "en", "de", None]), rnd.choice(["web", "web", "news", None, ""])) for i, t in enumerate(texts())]
    out += [(None, out[0][1], "en", "web"), (None, "no id at all", "en", "web"), (out[5][0], out[5][1], "de", "news"), out[7], out[7]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = [(0, 1, 0), (3, 0, 1), (6, 1, 1), (9, None, 1), (9, 1, None), (12, 1, 0), (12, 0, 0), (None, 1, 1), (15, 0, 1), (18, 1, 0), (999, 1, 1)]


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = ""
        found += "A" if len(words) < 200 else ""
        found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        found += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        found += "D" if re.search(r"[#$%&*|]", t) else ""
        found += "E" if i is not None and first[t] < i else ""
        yield i, source or "", found


def test_audit_equals_running_every_order(spark, docs, rows):
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    judged = list(failures(rows))
    expected = {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                out = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                fails = sum(letter in f for _, f in mine)
                total[letter] += len(out)
                expected[part, order, step] = [len(left), len(out), fails - len(out), sum(f == letter for _, f in mine), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), letter]
        for (p, _, _), row in expected.items():
            if p == part:
                row[-1] = total[row[-1]]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.document_cells(docs, labels)).collect()
    assert len(got) == len(expected) == 600 * 3
    for r in got:
        assert [r[m] for m in audit.MEASURES] == expected[r["part"], r["filter_order"], r["step"]]


def test_audit_of_other_filters_and_empty_tables(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.document_cells(empty, labels)).count() == 0
    assert audit.audit(audit.document_cells(docs, labels)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    table = spark.range(1000).select("id", (F.col("id") % 3).alias("p"))
    cells = audit.cells_of(table, F.col("p"), {"x": F.col("id") % 2 == 0, "y": F.when(F.col("id") < 500, F.lit(None)).otherwise(F.col("id") < 700)}, F.col("id") < 10, F.lit(None))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit(cells, "xy").collect()}
    assert len(got) == 3 * 2 * 2
    ids = [i for i in range(1000) if i % 3 == 1]
    x, y = {i for i in ids if i % 2 == 0}, {i for i in ids if 500 <= i < 700}
    second = got["1", "yx", 2]
    assert (second["kept"], second["removed"], second["redundant"], second["unique_fails"]) == (len(set(ids) - x - y), len(x - y), len(x & y), len(x - y))
    assert second["shapley"] == len(x) + len(x - y) and second["good_lost"] == len({i for i in x if i < 10})
    with pytest.raises(ValueError):
        audit.audit(cells, "xx")


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_words_of_long_texts_read_in_pieces(monkeypatch, size):
    monkeypatch.setattr(audit, "PIECE", size)
    raw = ("ab cd\tab  efg\n" * 50 + "long" * 20).encode()
    assert audit._words(raw) == (len(raw.split()), len(set(raw.split())))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(docs, rows, library, empty):
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs, RANKS).collect())
    assert got == expected
    assert byte_bpe.round_trip(empty, RANKS).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS), RANKS).count() == 0


def test_byte_bpe_offsets_and_split_characters(docs, library):
    coded = byte_bpe.encode(docs, RANKS)
    assert set(coded.columns) == {*docs.columns, "ends"}
    for r in byte_bpe.decode(coded, RANKS).collect():
        text = r["text"] or ""
        assert r["decoded"] == text and len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        covered = [text[a:b].encode() for a, b in zip(r["starts"], r["ends"], strict=True)]
        assert all(library.decode_single_token_bytes(t) in c for t, c in zip(r["ids"], covered, strict=True))
    c = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    (ids,) = c.encode(["日\U0001f600"])
    assert len(ids) > 2 and c.decode(ids).decode() == "日\U0001f600"
    assert "�" in c.decode(ids[:-1]).decode("utf-8", "replace")


def test_byte_bpe_null_ids(spark):
    got = byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), RANKS).collect()
    assert [r["decoded"] for r in got] == [None, ""]


@pytest.mark.parametrize("part", [1, 5, 1 << 18])
def test_byte_bpe_random_texts_in_parts(monkeypatch, library, part):
    """Long texts are cut where the pattern always parts; ids and offsets stay those of the whole text."""
    monkeypatch.setattr(byte_bpe, "PART", part)
    rnd = random.Random(part)
    c = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "the", "'s", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "　", "é", "12", "!", "日", "'"]) for _ in range(rnd.randrange(1, 40)))
        ((ids, start, end),) = c.encode_with_offsets([text])
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert end[-1] == len(text) and (start[1:] <= end[:-1]).all()


def phrases(rows, longest, least):
    """Counts, candidates and their scores by language, straight from the definition."""
    count, words = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = [p for p in f if len(p) > 1 and f[p] >= least]
        found = []
        for p in candidates:
            if any(100 * f[q] >= 50 * f[p] for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1000000 * f[p] * f[p] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found), 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return out


@pytest.mark.parametrize(("longest", "least", "top", "block"), [(3, 10, 2000, 700_000), (3, 10, 7, 50), (2, 3, 2000, 200), (5, 4, 2000, 300)])
def test_collocations_equal_brute_force(monkeypatch, docs, rows, longest, least, top, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    got = collocations.collocations(docs, longest, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = sorted(r for r in phrases(rows, longest, least) if r[1] <= top)
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 5


def test_collocations_of_little(spark, empty):
    assert collocations.collocations(empty).count() == 0
    few = spark.createDataFrame([(1, "one", None), (2, "", "en"), (3, None, "en"), (4, "a. b. c", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(few).count() == 0
    same = spark.createDataFrame([(1, "b a, " * 9 + "b\ta", None), (2, "c d. " * 10, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in collocations.collocations(same).orderBy("rank").collect()] == [("und", 1, "b a", 10, 10, 10, 40, 1000000), ("und", 2, "c d", 10, 10, 10, 40, 1000000)]


def test_collocation_scores_pass_64_bits(spark):
    row = spark.range(1).select(collocations._score(F.lit(3 * 10**12), F.lit(7 * 10**12), F.lit(5 * 10**12 + 1)).alias("s")).first()
    assert row["s"] == 10**6 * (3 * 10**12) ** 2 // (7 * 10**12 * (5 * 10**12 + 1))


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
def test_pieces_of_long_texts(monkeypatch, stretch):
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    assert [b" ".join(w) for w in collocations.piece_words(b"Aa  B\tc. d,,e f\x0bg\n\nhh")] == [b"aa b c", b"d", b"e f", b"g", b"hh"]
