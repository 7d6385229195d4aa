"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists every piece that ends at a position; the Viterbi step
keeps, per position, the best score and the number of pieces on the best path, so counts
need no path to be walked back. Rules of the tokenizer that decide the count:

* of equal scores the longest last piece wins (the first start found from the left);
* a character that no piece covers alone scores the smallest piece score less 10, and
  counts as one piece per UTF-8 byte (byte fallback) or, without it, one piece for a whole
  run of such characters;
* scores are added in double precision.

Where no piece spans two neighbouring characters, every path has a border, so a text is cut
there (in the usual vocabularies: before each word) and counts of its cut-outs are added.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices
from trialbook.llm.bpe import Recent

SPACE = "▁"
PENALTY = 10.0
#: Cut-outs longer than this are counted anew each time.
SHORT = 64


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.cuts_at_lines = byte_fallback and not any("\n" in p for p, _ in pieces)
        self.parts, self.spaced = Parts(self, ""), Parts(self, SPACE)

    def count(self, text: str) -> tuple[int, float]:
        """Pieces on the best path over ``text`` as it stands, and the path's score."""
        size = len(text)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        open_run = [False] * (size + 1)  # the best path ends in an uncovered character
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        done = (size, (0, 0.0))
        at, (length, score) = next(matches, done)
        single, fallback, unknown = self.single, self.byte_fallback, self.unknown
        for end in range(1, size + 1):
            top, n, is_open = None, 0, False
            while at == end - 1:  # pieces that end here, the longest first
                value = best[end - length] + score
                if top is None or value > top:
                    top, n = value, pieces[end - length] + 1
                at, (length, score) = next(matches, done)
            if text[end - 1] not in single:
                value = best[end - 1] + unknown
                if top is None or value > top:
                    top, is_open = value, True
                    extra = len(text[end - 1].encode()) if fallback else int(not open_run[end - 1])
                    n = pieces[end - 1] + extra
            best[end], pieces[end], open_run[end] = top, n, is_open
        return pieces[size], best[size]

    def total(self, text: str) -> tuple[int, float]:
        """Pieces and score of a raw text: spaces marked, one mark before it, nothing if empty."""
        if not text:
            return 0, 0.0
        if not self.cuts_at_spaces or (not self.byte_fallback and SPACE not in self.single):
            return self.count(SPACE + text.replace(" ", SPACE))
        # a character in no piece stands alone on every path
        lines = (" " + text).split("\n") if self.cuts_at_lines else [" " + text]
        n = len(lines) - 1
        score = n * self.unknown
        for line in lines:
            first, *words = line.split(" ")
            if "" in words or SPACE in line:  # marks in a row belong together
                found = map(self.parts.__getitem__, WORD.findall(line.replace(" ", SPACE)))
            else:
                found = map(self.spaced.__getitem__, words)
                a, b = self.parts[first]
                n += a
                score += b
            for a, b in found:
                n += a
                score += b
        return n, score


class Parts(Recent):
    """Counts of cut-outs, with what stands before each of them."""

    def __init__(self, vocabulary: Vocabulary, before: str):
        super().__init__()
        self.vocabulary, self.start = vocabulary, before

    def __missing__(self, part: str) -> tuple[int, float]:
        found = self.before.get(part) or self.vocabulary.count(self.start + part)
        return self.keep(part, found) if len(part) <= SHORT else found


#: A run of space marks with what follows it, or what comes before the first of them: between
#: any two of these lies a sure border.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The pieces of a model file that match text (no control, byte or unknown pieces)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    ordinary = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    fallback = any(model.is_byte(i) for i in range(size))
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in ordinary], fallback)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, characters, number of tokens and score of the best path.

    Null and empty texts have 0 tokens and score 0. Repeated rows stay repeated; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches):
        vocabulary = load(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [vocabulary.total(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=[key, "n_chars", "n_tokens", "score"],
            )

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_chars long, n_tokens long, score double")
