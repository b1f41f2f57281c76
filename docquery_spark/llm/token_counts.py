"""Token counts of a unigram vocabulary: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at a position, and
dynamic programming keeps for each position only the best score and its piece count. The rules are
those of the public unigram tokenizer: runs of ASCII white space become one word-start mark, the text gets
one in front; a start is improved only by a strictly better score, so of equal paths the one with
the longest last piece stays; a character that no piece covers costs the lowest score less 10, and
counts as its UTF-8 bytes when the vocabulary has byte pieces, else as one piece (runs of them
together as one). Scores are added as 32-bit floats.

The vocabulary's pieces carry the mark only in front, so words are independent: the DP runs once a
distinct word and batch, and counts are kept in a bounded table of each Python worker.

With ``untouched``, white space is counted as the file's own normalizer has it (identity, nothing
removed): each blank is a mark, runs of them are kept and may be pieces, and any other white space is
a character like others, so that a word after it bears no mark. Scores are then added as 64-bit
floats: a newline's cost would leave 32-bit ones too coarse for the scores after it, and a word's
count would hang on all text before it.

The vocabulary file is a parameter; it is read on the driver and its pieces are broadcast (their
number is the vocabulary's size and is checked). No tokenizer is trained.

Nulls: a null text has 0 tokens; so has an empty one and, unless ``untouched``, one of white space only. Very long words
take time in proportion to their length. Repeated rows give repeated rows; other columns are kept
unless named like the output column, which replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import quoted

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_PIECES = 1_000_000
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers (twice as many at most), and the longest that it does.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64
#: White space: the ASCII six.
SPACES = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")
SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the ordinary pieces in the file, and whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in plain]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces; {MAX_PIECES} at most are broadcast")
    return pieces, any(model.is_byte(i) for i in ids)


class CountViterbi:
    """Piece counts of words under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, runs: bool = False):
        import ahocorasick

        self.byte_fallback, self.wide = byte_fallback, runs
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if len(piece) > 1 and MARK in piece[1:] and piece.strip(MARK):
                raise ValueError(f"{piece!r} spans a word start")
            if not runs and not piece.strip(MARK) and len(piece) > 1:
                continue  # runs of marks can't match: runs of white space are one mark
            self.automaton.add_word(piece, (len(piece), float(np.float32(score))))
        self.automaton.make_automaton()
        scores = [float(np.float32(s)) for _, s in pieces]
        self.unknown = min(scores) - UNKNOWN_PENALTY if runs else float(np.float32(min(scores)) - np.float32(UNKNOWN_PENALTY))
        #: Whole numbers add up exactly as 32-bit floats down to this sum; others never do.
        self.exact_sum = -float(1 << 24) if all(s == int(s) and s <= 0 for s in scores) else math.inf
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word without its mark."""
        text = MARK + word
        n = len(text)
        if self.singles.issuperset(text):
            # Each end's last match is the character itself, which settles it. Sums only fall along a
            # path, so if the last one is in the exact range, all on the best path were.
            values, counts, top, pieces = [0.0], [0], -math.inf, 0
            for end, (length, score) in self.automaton.iter(text):
                start = end + 1 - length
                value = values[start] + score
                if value > top:
                    top, pieces = value, counts[start] + 1
                if length == 1:
                    values.append(top)
                    counts.append(pieces)
                    top = -math.inf
            if values[n] > self.exact_sum:
                return counts[n]
        return self._path(text)

    def _add(self, value: float, score: float) -> float:
        return value + score if self.wide else float(np.float32(value) + np.float32(score))

    def _path(self, text: str) -> int:
        """Pieces of the best path over a text with its marks."""
        n = len(text)
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # positions before this end have their best path
        top = single = None
        # for each end the matches come longest first: of equal scores the longest stays
        for end, (length, score) in self.automaton.iter(text):
            while done < end:
                self._close(text, done, top, single, best, count, open_)
                top, single, done = None, False, done + 1
            start = end + 1 - length
            value = self._add(best[start], score)
            if top is None or value > top[0]:
                top = (value, count[start] + 1, False)
            single = length == 1
        while done < n:
            self._close(text, done, top, single, best, count, open_)
            top, single, done = None, False, done + 1
        return count[n]

    def _close(self, text, end, top, single, best, count, open_):
        """Settles the best path to the position after ``end``."""
        if not single:
            value = self._add(best[end], self.unknown)
            if top is None or value > top[0]:
                top = (value, count[end] + (len(text[end].encode()) if self.byte_fallback else int(not open_[end])), True)
        best[end + 1], count[end + 1], open_[end + 1] = top

    def text(self, text: str | None) -> int:
        memo, total = self.memo, 0
        for w in text.translate(SPACES).split(" ") if text else ():
            if not w:
                continue
            n = memo.get(w)
            if n is None:
                n = self.old.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_WORDS:
                        self.old, self.memo = memo, {}
                        memo = self.memo
                    memo[w] = n
            total += n
        return total


    def untouched(self, text: str | None) -> int:
        """Pieces of a text with all its white space; needs ``runs``."""
        total = 0
        for part in SEGMENTS.findall(MARK + text.replace(" ", MARK)) if text else ():
            n = self.memo.get(part)
            if n is None:
                n = self.old.get(part)
                if n is None:
                    n = self._path(part)
                if len(part) <= MEMO_LENGTH:
                    if len(self.memo) >= MEMO_WORDS:
                        self.old, self.memo = self.memo, {}
                    self.memo[part] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, untouched: bool = False) -> DataFrame:
    """docs (its columns ``keep``, or all) with the number of tokens of each text."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        viterbi = CountViterbi(*pieces.value, runs=untouched)
        count = viterbi.untouched if untouched else viterbi.text
        for texts in batches:
            yield pd.Series(np.fromiter(map(count, texts.tolist()), dtype=np.int64, count=len(texts)))

    kept = [F.col(quoted(c)) for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    return docs.select(*kept, counted(F.col(quoted(text)).cast("string")).alias(out))
