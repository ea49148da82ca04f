"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary lists every piece that ends at each character of a word; dynamic programming carries, for each end, the
best score and its number of pieces, and no path. The tokenizer's rules are kept: of equal scores the first found
wins, and pieces are found by ascending start; where no piece of one character fits, one unknown character is taken at the
lowest piece score less 10; unknown characters that follow each other are one piece, or one piece for each byte where the vocabulary has byte pieces.

Words begin at a blank, which is replaced by the word mark; text before the first blank gets a mark too unless it has one (Metaspace with
``prepend_scheme`` always and ``split``). Words are independent, so a bounded cache of each worker counts a distinct word once.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows are counted alike; null ids keep their rows; an
empty table gives no rows; a vocabulary without pieces is refused. Only the text column is read, other columns pass through.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import filterfalse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_LESS = 10.0
#: Words kept per worker, and words of a text at a time.
CACHE_WORDS, WORDS_AT_ONCE = 600_000, 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """(piece, score) pairs; byte_pieces: unknown characters become byte pieces where the vocabulary has them."""

    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool = True

    def __post_init__(self):
        if not self.pieces:
            raise ValueError("the vocabulary has no pieces")


def from_sentencepiece(path: str | None = None, byte_pieces: bool = True) -> Vocabulary:
    """The ordinary pieces and their scores of a sentencepiece file, read as a unigram vocabulary; control, unused and byte pieces are no text."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    skip = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    has_bytes = sum(sp.is_byte(i) for i in range(n)) == 256
    return Vocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not skip[i] and sp.id_to_piece(i)), byte_pieces and has_bytes)


class Counter:
    """Counts the pieces of words."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in v.pieces:
            scores.setdefault(piece, score)
        for piece, score in scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown, self.byte_pieces = min(scores.values()) - UNKNOWN_LESS, v.byte_pieces
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = bytearray(n)
        for last, (size, score) in self.matches.iter(text):
            ends[last].append((last + 1 - size, score))
            if size == 1:
                single[last] = 1
        # best score to each place, pieces on the way there, and whether the last piece is unknown
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for last in range(n):
            found = ends[last]
            if not single[last]:
                found.append((last, None))
            found.sort(key=lambda x: x[0])
            top = None
            for start, score in found:
                total = best[start] + (self.unknown if score is None else score)
                if top is None or total > top:
                    top, at, unknown = total, start, score is None
            best[last + 1], loose[last + 1] = top, unknown
            if not unknown:
                count[last + 1] = count[at] + 1
            elif self.byte_pieces:
                count[last + 1] = count[at] + len(text[last].encode("utf-8", "surrogatepass"))
            else:
                count[last + 1] = count[at] + (not loose[at])
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        first, *words = text.replace(" ", MARK).split(MARK)
        words = [MARK + w for w in words]
        if first:
            words.insert(0, MARK + first)
        known, total = self.known, 0
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            new = set(filterfalse(known.__contains__, part))
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(part)
            known.update([(w, self.word(w)) for w in new])
            total += sum(map(known.__getitem__, part))
        return total


_COUNTERS: dict[str, Counter] = {}


def count(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text; no shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary or from_sentencepiece()), uuid.uuid4().hex  # one vocabulary

    @F.pandas_udf("long")
    def n(texts: pd.Series) -> pd.Series:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        return texts.map(_COUNTERS[key]) if texts.notna().all() else pd.Series([_COUNTERS[key](t) for t in texts], dtype="int64")

    return docs.withColumn(out_col, n(F.col(text_col).cast("string")))
