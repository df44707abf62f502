"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces are counted in one pass over a word's characters: a
vocabulary trie carries failure links and, with each link, how many pieces are popped by
following it. Pieces themselves are never built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"\w+|[^\w\s]"
BLOCK_WORDS, MEMO_WORDS = 1 << 16, 250_000
UNKNOWN = -1


class Automaton:
    """Trie of first pieces and, below a second root, of pieces that continue a word."""

    START, INSIDE = 0, 1

    def __init__(self, first: Iterable[str], inside: Iterable[str]):
        self.step: dict[int, int] = {}  # node and character in one number
        children: list[list[tuple[int, int]]] = [[], []]
        ends = [False, False]
        for root, pieces in ((self.START, first), (self.INSIDE, inside)):
            for piece in pieces:
                node = root
                for c in map(ord, piece):
                    if (after := self.step.get(node << 21 | c)) is None:
                        after = self.step[node << 21 | c] = len(ends)
                        children[node].append((c, after))
                        children.append([])
                        ends.append(False)
                    node = after
                ends[node] = ends[node] or bool(piece)
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([self.START, self.INSIDE])
        while queue:
            node = queue.popleft()
            for c, child in children[node]:
                queue.append(child)
                if ends[child]:
                    self.link[child], self.popped[child] = self.INSIDE, 1
                    continue
                at, popped = self.link[node], self.popped[node]
                while at >= 0 and at << 21 | c not in self.step:
                    popped, at = popped + self.popped[at], self.link[at]
                if at >= 0:
                    self.link[child], self.popped[child] = self.step[at << 21 | c], popped

    def count(self, word: str) -> int:
        """Pieces of the word, or UNKNOWN where pieces can't cover it."""
        step, link, popped, node, pieces = self.step.get, self.link, self.popped, self.START, 0
        for c in map(ord, word):
            while (after := step(node << 21 | c)) is None:
                if link[node] < 0:
                    return UNKNOWN
                pieces += popped[node]
                node = link[node]
            node = after
        while node != self.INSIDE:
            if link[node] < 0:
                return UNKNOWN if word else 0
            pieces += popped[node]
            node = link[node]
        return pieces


class Counter(dict):
    """Counts of the words seen last; a missing word runs through the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n

    def text(self, text: str, words: regex.Pattern) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words, block by block."""
        n_words = n_tokens = n_unknown = 0
        matches = (m.group() for m in words.finditer(text))
        short = [words.findall(text)] if len(text) <= BLOCK_WORDS else None
        for block in short or iter(lambda: list(islice(matches, BLOCK_WORDS)), []):
            counts = list(map(self.__getitem__, block))
            n_words, n_tokens, n_unknown = n_words + len(block), n_tokens + sum(map(abs, counts)), n_unknown + counts.count(UNKNOWN)
        return n_words, n_tokens, n_unknown


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """First and inside pieces of a piece model: a leading mark makes a piece start a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p[0] == "▁" and p[1:]], [p for p in plain if p[0] != "▁"]


def counts_column(spark: SparkSession, text: Column, path: str, words: str = WORD) -> Column:
    """n_words, n_tokens and n_unknown of whole texts; null counts as empty.

    The automaton is made on the driver and broadcast; its size is the vocabulary's.
    """
    shared = spark.sparkContext.broadcast(Automaton(*read_pieces(path)))

    @F.arrow_udf("n_words long, n_tokens long, n_unknown long")
    def counts(texts: pa.Array) -> pa.Array:
        pattern, found = regex.compile(words), Counter(shared.value)
        rows = [found.text(t.as_py() or "", pattern) for t in texts]
        return pa.array([dict(zip(("n_words", "n_tokens", "n_unknown"), r)) for r in rows],
                        pa.struct([(n, pa.int64()) for n in ("n_words", "n_tokens", "n_unknown")]))

    return counts(text)
