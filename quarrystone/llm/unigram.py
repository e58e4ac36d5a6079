"""Token counts of a unigram tokenizer: Viterbi that carries scores and counts only."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, widened, without

#: What the tokenizer splits words at: Unicode white space.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Stands for the space before a word.
MARK = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Letters of words whose counts a worker remembers, about; beyond it forgets all and starts anew. Words of more than LONG letters aren't remembered.
REMEMBERED, LONG = 64 << 20, 64


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and unigram scores from a sentencepiece file: ordinary pieces in their order, scored by the logarithm of their place.

    The file's merge ranks are no log-probabilities; a Zipf rule over the same order is.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    kept = [x for x in plain if x.strip(MARK)] + [MARK]
    return [(x, -math.log(k + 2)) for k, x in enumerate(dict.fromkeys(kept))]


class Counter:
    """Counts pieces of words.

    The best path to each place takes, of the pieces that end there, the one with the highest total;
    of equal totals, the one that starts first. A character with no piece of its own may be unknown, and neighbouring
    unknown characters are one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.held = 0

    def pieces(self, word: str) -> int:
        """Pieces of a word; the automaton gives those that end at a place from the longest on."""
        n = len(word)
        score, count, odd = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        found = self.automaton.iter(word)
        upcoming = next(found, None)
        for end in range(1, n + 1):
            single = False
            top, from_, unknown = -math.inf, -1, False
            while upcoming is not None and upcoming[0] == end - 1:
                size, s = upcoming[1]
                total = s + score[end - size]
                if from_ < 0 or total > top:
                    top, from_ = total, end - size
                single |= size == 1
                upcoming = next(found, None)
            if not single:
                total = self.unknown + score[end - 1]
                if from_ < 0 or total > top:
                    top, from_, unknown = total, end - 1, True
            score[end], odd[end] = top, unknown
            count[end] = count[from_] + (not (unknown and odd[from_] and from_ > 0))
        return count[n]

    def count(self, text: str | None) -> int:
        known, total = self.known, 0
        for w in _SPACE.split(text or ""):
            if w:
                c = known.get(w)
                if c is None:
                    c = self.pieces(MARK + w)
                    if len(w) <= LONG:
                        if self.held > REMEMBERED:
                            known.clear()
                            self.held = 0
                        known[w] = c
                        self.held += len(w) + 100  # what an entry takes besides
                total += c
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(piece_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """docs (without its text, if that isn't to be kept) with the number of unigram pieces of each whole text, in one pass without a shuffle.

    A null or empty text has none. Words are counted apart, as the tokenizer splits at white space, and short ones are remembered; a long text
    without a space is one word and takes memory in proportion to its length. Texts are counted as they stand: a tokenizer that normalises them first
    needs normalised texts here. Repeated rows stay; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    docs = without(docs, out)
    named = [c for c in docs.columns if c != text]
    docs = docs.select(*named, text)
    kept = docs if keep_text else docs.drop(text)
    kept_names = kept.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            made = pa.array([c.count(t) for t in b.column(len(named)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept_names)], made], names=[*kept_names, out])

    return docs.mapInArrow(each, widened(kept, **{out: "long"}))
