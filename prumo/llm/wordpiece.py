"""Token counts by greedy longest match in one pass over the letters.

The vocabulary is a trie. For each node the pieces that greedy matching must give up from the front of its text, once no
longer piece can follow, are known beforehand: a failure link leads to the node of what is left, and the number of
pieces popped on the way is stored. So a word is counted letter by letter without going back and without building pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prumo.llm.common import Remembered, once_per_worker, sums_per_list

START = "▁"  # begins a word


class Automaton:
    """Counts pieces. A letter that is no piece counts as its UTF-8 bytes (byte fallback)."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        cost: dict[int, int] = {}
        pieces = sorted(set(pieces) - {""})
        # Every letter inside a piece can stand alone, as a piece or as bytes, so matching never gets stuck.
        for text, worth in [(p, 1) for p in pieces] + [(c, len(c.encode())) for c in sorted({c for p in pieces for c in p})]:
            node = 0
            for letter in text:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                node = self.next[node][letter]
            cost.setdefault(node, worth)
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        waiting = deque([0])
        while waiting:  # nodes by depth: a link always leads to a shorter text
            node = waiting.popleft()
            for letter, child in self.next[node].items():
                if child in cost:
                    self.popped[child] = cost[child]
                else:
                    left, count = self.link[node], self.popped[node]
                    while letter not in self.next[left]:
                        count, left = count + self.popped[left], self.link[left]
                    self.link[child], self.popped[child] = self.next[left][letter], count
                waiting.append(child)

    def count(self, text: str) -> int:
        """Pieces of greedy longest match from the left."""
        after, link, popped = self.next, self.link, self.popped
        node = total = 0
        for letter in text:
            while letter not in after[node]:
                if node == 0:
                    total += len(letter.encode())
                    break
                total, node = total + popped[node], link[node]
            else:
                node = after[node][letter]
        while node:
            total, node = total + popped[node], link[node]
        return total


def pieces_of(path: str) -> list[str]:
    """The pieces of a SentencePiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def token_counts(spark: SparkSession, pieces: list[str], text: Column) -> Column:
    """struct<n_words, n_tokens> of a text: words are runs without Unicode white space, each counted with START before it.

    A null, empty or blank text has no words and no tokens. Texts of any length are read whole; equal texts
    count alike. The vocabulary is a table bounded by its file; it goes to the tasks.
    """
    shared, tag = spark.sparkContext.broadcast(list(pieces)), uuid4().hex

    class Counter:
        def __init__(self):
            self.automaton = Automaton(shared.value)
            self.words = Remembered(self.count_all)

        def count_all(self, words: list[str]) -> np.ndarray:
            return np.array([self.automaton.count(START + w) for w in words], dtype=np.int64)

    @F.arrow_udf("struct<n_words: long, n_tokens: long>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = once_per_worker(tag, Counter)
        for texts in batches:
            words = [text.split() if text else [] for text in texts.to_pylist()]
            sizes = list(map(len, words))
            tokens = sums_per_list(counter.words.of(words), sizes).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens)], ["n_words", "n_tokens"])

    return counted(text)
