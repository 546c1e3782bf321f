"""Greedy word-piece lengths by a linear longest-match automaton.

Every trie node of the vocabulary carries, for the case that matching fails there,
the number of pieces that greedy matching pops and the node at which it goes on
(the failure link).  A word is walked once, left to right; no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_TABLES, slices
from .sentencepiece_codec import NORMAL, SPACE, _fields

CACHE_ENTRIES = 500_000
WORD = re.compile("[^\x20\x09-\x0d]+")


def piece_vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece model file; a leading mark begins a word."""
    with open(path, "rb") as f:
        parsed = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    return [d[1].decode() for d in parsed if d.get(3, NORMAL) == NORMAL]


class LongestMatch:
    """Automaton over a vocabulary of pieces.

    A character that no piece begins with is one piece of its own.
    """

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        parent: list[tuple[int, str]] = [(0, "")]
        for piece in vocabulary:
            node = 0
            for ch in piece:
                to = self.next[node].get(ch)
                if to is None:
                    to = len(self.next)
                    self.next[node][ch] = to
                    self.next.append({})
                    final.append(False)
                    parent.append((node, ch))
                node = to
            final[node] = bool(node)
        # a lone character is always a piece, so every node has a piece to pop
        for node in self.next[0].values():
            final[node] = True
        #: node to go on from when no edge fits, and the pieces popped by that step
        self.fail = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            up, ch = parent[node]
            if final[node]:
                self.popped[node] = 1
            else:
                at, count = self.fail[up], self.popped[up]
                while at and ch not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if ch in self.next[at]:
                    at = self.next[at][ch]
                else:
                    count += 1
                self.fail[node], self.popped[node] = at, count
            todo.extend(self.next[node].values())
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match over ``word``."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for ch in word:
            to = step[node].get(ch)
            while to is None:
                if node == 0:
                    total += 1
                    break
                total += popped[node]
                node = fail[node]
                to = step[node].get(ch)
            node = to if to is not None else 0
        while node:
            total += popped[node]
            node = fail[node]
        return total

    def text_count(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of a text; each word is matched with a leading mark."""
        words = WORD.findall(text or "")
        cache, total = self.cache, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.count(SPACE + w)
                if len(w) < 100:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[w] = n
            total += n
        return len(words), total


_automata: dict[tuple[int, int], LongestMatch] = WORKER_TABLES.setdefault("wordpiece", {})


def count_tokens(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words and n_tokens (long) of the whole text.

    Words are runs of anything but ASCII white space.  A null text has no words.
    Repeated rows are each counted, a null key is kept.  The vocabulary is fixed
    and small; it travels as one broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tag = (len(vocabulary), hash(tuple(vocabulary)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _automata:
            _automata[tag] = LongestMatch(shared.value)
        automaton = _automata[tag]
        for piece in slices(batches, keep="wordpiece"):
            done = [automaton.text_count(t) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())], ["key", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_tokens long").withColumnRenamed("key", key)
