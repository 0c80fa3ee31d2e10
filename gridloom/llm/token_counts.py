"""Token counts of a unigram tokenizer, without the tokens: the best segmentation's score and length alone.

An Aho-Corasick automaton gives, at each place of a word, the vocabulary's pieces that end there; a dynamic programme
carries the best score and its number of pieces. Ties go as in the usual implementations: of equal scores the piece that
starts first stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an unknown character's score is below that of the worst piece.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
CACHED_WORDS = 300_000


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a SentencePiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class Counter(dict):
    """Piece counts by stretch of text; forgets all when full, which changes no result.

    A text, with MARK for each space, is cut before a MARK that no piece spans: one whose character before never stands
    before a MARK within a piece. The best segmentation of the whole is then that of its stretches."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        #: No piece holds a line feed, so what stands before and after one is segmented apart.
        self.lines = not any("\n" in piece for piece, _ in pieces)
        #: Characters that a piece has right before a MARK.
        self.spanned = "".join(sorted({a for piece, _ in pieces for a, b in zip(piece, piece[1:], strict=False) if b == MARK}))
        self.cut = re.compile(f"(?<![{re.escape(self.spanned)}])(?={MARK})" if self.spanned else f"(?={MARK})")

    def __missing__(self, word: str) -> int:
        if self.lines and "\n" in word and word != "\n":
            first, *rest = word.split("\n")
            count = (self[first] if first else 0) + sum(self["\n"] + (self[x] if x else 0) for x in rest)
        else:
            count = self.count(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = count
        return count

    def count(self, word: str) -> int:
        """Pieces of the best segmentation, a character that no piece covers counting a token for each of its bytes."""
        best = [0.0] * (len(word) + 1)
        pieces = [0] * (len(word) + 1)
        at = -1  # the last place whose pieces have been compared
        found: float | None = None
        many = 0
        single = False

        def close(end: int) -> None:
            # A character without a piece of its own may also be unknown.
            nonlocal found, many, single
            if not single:
                score = best[end] + self.unknown
                if found is None or score > found:
                    found, many = score, pieces[end] + len(word[end].encode())
            best[end + 1], pieces[end + 1] = found, many
            found, many, single = None, 0, False

        for end, (length, score) in self.automaton.iter(word):  # at one end, longer pieces first
            while at + 1 < end:
                at += 1
                close(at)
            start = end + 1 - length
            total = score + best[start]
            if found is None or total > found:
                found, many = total, pieces[start] + 1
            single = single or length == 1
        while at + 1 < len(word):
            at += 1
            close(at)
        return pieces[-1]

    def text(self, text: str) -> int:
        """Each space becomes MARK, and one more stands before the text unless it starts with a space."""
        if not text:
            return 0
        if self.spanned in ("", MARK) and "  " not in text:  # single spaces: every one starts a stretch
            words = text.split(" ")
            return sum(map(self.__getitem__, [MARK + w for w in (words if words[0] else words[1:])]))
        marked = text.replace(" ", MARK)
        return sum(map(self.__getitem__, filter(None, self.cut.split(marked if marked[0] == MARK else MARK + marked))))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id (of any type), n_chars (code points) and n_tokens of the whole text. A null or empty text has none;
    repeated rows are counted each; other columns are ignored. The model file must be at model_path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = Counter(vocabulary(model_path))
        counter = _COUNTERS[model_path]
        for batch in batches:
            chars, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                chars[k], tokens[k] = len(text), counter.text(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chars), pa.array(tokens)], names=["doc_id", "n_chars", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long")
