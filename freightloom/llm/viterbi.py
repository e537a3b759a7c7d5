"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary finds all pieces in a word; a Viterbi pass keeps, for each position, the best score and the
number of pieces on that path. Ties follow the tokenizer: only a strictly higher score replaces, so of equal paths the one whose last piece starts first (the longest last piece) wins.
A character no one-character piece covers may become an unknown: its score is the lowest score less 10; neighbouring unknowns are one
unknown, which becomes its UTF-8 bytes where the vocabulary has byte pieces.

Text is cut into words at spaces; each starts with the mark of a space. Words repeat, so a worker remembers the counts of the last ones.
Null text counts 0, and so does empty text. Rows are independent: repeated rows, long texts and other columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from freightloom.llm.common import documents

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


@lru_cache(maxsize=2)
def unigram_pieces(path: str) -> tuple[tuple[str, float], ...]:
    """The pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))


class Counter(dict):
    """word -> number of pieces. Forgets all when full."""

    def __init__(self, pieces: tuple[tuple[str, float], ...], unknown: int = 0):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
            elif piece:  # a piece listed twice has its last score
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self.count(MARK + word)
        if len(word) < 100:
            self[word] = out
        return out

    def count(self, s: str) -> int:
        n = len(s)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        alone = [False] * n
        for end, (length, score) in self.automaton.iter(s):
            ending[end + 1].append((length, score))
            if length == 1:
                alone[end] = True
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # unknown: length of the run of unknowns a path ends with
        for end in range(1, n + 1):
            top, count, run = None, 0, 0
            options = ending[end]
            if not alone[end - 1]:
                options = [*options, (1, None)]
            for length, score in sorted(options, key=lambda x: -x[0]):  # earlier starts first
                start = end - length
                value = best[start] + (self.unknown_score if score is None else score)
                if top is None or value > top:
                    top = value
                    if score is None:
                        size = len(s[start].encode()) if self.by_bytes else (0 if unknown[start] else 1)
                        count, run = pieces[start] + size, unknown[start] + 1
                    else:
                        count, run = pieces[start] + 1, 0
            best[end], pieces[end], unknown[end] = top, count, run
        return pieces[n]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(unigram_pieces(path))


def marked_words(text: str) -> list[str]:
    """What stands behind each mark once spaces are marks: the library puts one before a text unless it starts with a space or the mark itself."""
    text = text.replace(MARK, " ")
    return (text[1:] if text[0] == " " else text).split(" ")


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens."""
    path = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path).__getitem__
        for batch in batches:
            counts = [sum(map(of, marked_words(text))) if (text := t.as_py()) else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
