"""Token counts of a unigram tokenizer, without building the tokens.

A text is cut before each space mark, as the tokenizer's own pre-tokenizer does,
so pieces never cross words. In a word an Aho-Corasick automaton lists every
vocabulary piece, and dynamic programming over the ends of pieces carries the
best score and its number of pieces. Ties are broken as the tokenizer does: at
each end the match that starts first is kept unless a later one scores strictly
more; a character without a piece of its own also is an unknown match, tried
after the pieces that start there; neighbouring unknown characters are one
piece, which byte fallback turns into a piece per byte.
"""

import itertools
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space and precedes each word.
MARK = "▁"
# Fixed value of the tokenizer: an unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, and the longest word that it remembers.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, without its special pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


class Counter:
    """Piece counts under a unigram vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.remembered = lru_cache(REMEMBERED)(self.word)

    def word(self, word: str) -> int:
        """Pieces of the best path over one word."""
        size, unknown = len(word), self.unknown
        scores, counts = [0.0] * (size + 1), [0] * (size + 1)
        end, at, best, single = 0, -1, 0.0, True

        # Matches come by their end, and of one end the longest first, so the earliest start first.
        matches = self.automaton.iter(word) if len(self.automaton) else ()
        for last, (length, score) in itertools.chain(matches, ((size, (1, 0.0)),)):
            while end <= last:
                # Close this end, and open the next.
                if not single and (at < 0 or scores[end - 1] + unknown > best):
                    scores[end], counts[end] = scores[end - 1] + unknown, counts[end - 1] + len(word[end - 1].encode())
                elif end:
                    scores[end], counts[end] = best, counts[at] + 1
                end += 1
                at, best, single = -1, 0.0, False
            total = scores[end - length] + score
            if at < 0 or total > best:
                at, best = end - length, total
            single = single or length == 1
        return counts[size]

    def text(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]  # a leading space is the first word's own mark
        total = 0
        for word in words:
            word = MARK + word
            total += self.remembered(word) if len(word) <= REMEMBERED_LENGTH else self.word(word)
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs`` (doc_id, text).

    Counts equal those of a unigram tokenizer with this vocabulary, byte fallback
    and a space mark before each word. Null and empty texts have 0 tokens; texts
    are read whole; repeated rows stay repeated. The vocabulary, bounded by its
    file, is broadcast, and each task builds the automaton from it once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            found = [counter.text(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(counted, f"doc_id {kind}, n_tokens long")
