"""Token counts of a unigram model without tokens: a Viterbi pass that carries score and count only."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose counts a worker remembers at most.
REMEMBERED = 400_000
#: Fixed value: what an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts the tokens of a unigram tokenizer with byte fallback: pieces (text, score), the unknown one among them.

    White space becomes SPACE, one goes before the text, and each SPACE starts a word. In a word the segmentation
    with the best score wins; of equal ones, at each end the one whose last piece starts first. Unknown
    characters in a row make one unknown piece, spelled in bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.trie = ahocorasick.Automaton()
        self.unknown_text = vocabulary[unknown][0]
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), float(score)))
        self.trie.make_automaton()
        self.known = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.low = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.words: dict[str, int] = {}
        self.split = re.compile(f"{SPACE}[^{SPACE}]*")

    def word(self, text: str) -> int:
        size = len(text)
        if self.known.issuperset(text) and self.unknown_text not in text:
            score, count = [0.0] + [-math.inf] * size, [0] * (size + 1)
            for last, (length, points) in self.trie.iter(text):  # at each end longest first, that is smallest start first
                start = last + 1 - length
                points += score[start]
                if points > score[last + 1]:
                    score[last + 1], count[last + 1] = points, count[start] + 1
            return count[size]
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        # of the unknown run that ends here: its bytes, and whether it is the unknown piece's own text
        run, own = [0] * (size + 1), [False] * (size + 1)
        matches, unknown = iter(self.trie.iter(text)), len(self.unknown_text)
        last, found = next(matches, (size, None))
        for end in range(1, size + 1):
            best, start, single = None, 0, False
            while last == end - 1:
                length, points = found
                single |= length == 1
                points += score[end - length]
                if best is None or points > best or (points == best and end - length < start):
                    best, start = points, end - length
                last, found = next(matches, (size, None))
            if not single:
                points = score[end - 1] + self.low
                if best is None or points > best:
                    best, start = points, -1
            score[end] = best
            literal = start >= 0 and end - start == unknown and text.startswith(self.unknown_text, start)
            if start < 0 or literal:
                begin = end - 1 if start < 0 else start
                count[end] = count[begin]
                own[end] = literal and not run[begin]
                run[end] = run[begin] + len(text[begin:end].encode())
            else:
                count[end] = count[start] + (1 if own[start] else run[start]) + 1
        return count[size] + (1 if own[size] else run[size])

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        total, known = 0, self.words
        for word in self.split.findall(text if text[0] == SPACE else SPACE + text):
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.word(word)
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total


def unigram_vocabulary(model: str) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file with the scores that it gives them."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


@lru_cache(2)
def counter(model: str) -> Counter:
    return Counter(unigram_vocabulary(model))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and n_tokens, the tokens of its whole text; null and empty texts have none.

    Texts of any length are counted whole; ids may be null or come twice; other columns are ignored, whatever their
    names; an empty table gives an empty one. model: a path that every executor has.
    """

    def counted(batches):
        c = counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t.as_py() or "") for t in b.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(counted, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
