"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match that ends at each place of a word, longest first. The
dynamic programme carries the best score and the number of pieces of the best cut, no cut itself. Ties go as in the
tokenizers library's Unigram model: a later start replaces an earlier one only with a higher score; a character that
is no piece itself costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).

The vocabulary file on hand holds byte-fallback BPE pieces, so they get the scores of a Zipf law of their rank, from
the rule in `zipf_scores`. Words come from the library's WhitespaceSplit and Metaspace rules. Counts equal those of the
library's Unigram model on the same pieces and scores; tests compare the two.

Words are counted once per worker and kept in two generations of bounded size, so cost follows distinct words.

Defined cases: null, empty and blank texts have zero tokens; texts and words of any length are cut as a whole; repeated
rows, ids and nulls of doc_id come back as they are, a row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass
from skarn.llm.wordbpe import resolve

DEFAULT_PIECES = "piece_bpe_32k.model"
#: Fixed values of the tokenizers library's Unigram model.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKED = re.compile(f"{MARK}[^{MARK}]*")
_LONG_KEY = 64


def pieces_of(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def zipf_scores(pieces: list[str]) -> list[tuple[str, float]]:
    """Log-probabilities of a Zipf law: piece number i has 1 / ((i + 1) * harmonic number)."""
    whole = math.fsum(1 / (i + 1) for i in range(len(pieces)))
    return [(p, -math.log((i + 1) * whole)) for i, p in enumerate(pieces)]


class Counter(dict):
    """Word with its mark -> number of pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]], kept: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.kept, self.old = kept, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = sum(map(self.viterbi, _MARKED.findall(word if word[0] == MARK else MARK + word)))
        if len(word) <= _LONG_KEY:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def viterbi(self, word: str) -> int:
        best, count = [0.0], [0]
        matches = self.automaton.iter(word)
        end, found = next(matches, (len(word), None))
        for at, char in enumerate(word):
            top = n = None
            while end == at:
                start = at + 1 - found[0]
                score = found[1] + best[start]
                if top is None or score > top:
                    top, n = score, count[start] + 1
                end, found = next(matches, (len(word), None))
            if char not in self.single:
                score = self.unknown + best[at]
                if top is None or score > top:
                    top, n = score, count[at] + len(char.encode())
            best.append(top)
            count.append(n)
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = filter(None, _WHITE.split(text)) if _SEPARATORS.search(text) else text.split()
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(zipf_scores(pieces_of(path)))


def library_tokenizer(path: str = DEFAULT_PIECES):
    """The same tokenizer as the tokenizers library has it; tests compare with it."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.Unigram(zipf_scores(pieces_of(path)), unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(MARK, prepend_scheme="always", split=True)])
    return whole


def token_counts(documents: DataFrame, path: str = DEFAULT_PIECES) -> DataFrame:
    """doc_id, n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return arrow_pass(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long")
