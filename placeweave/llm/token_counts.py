"""Token counts by a longest-match automaton that never builds the pieces.

The vocabulary is a trie over bytes. A node where no edge fits has a failure link, to the node
for what is left after the greedy pieces of the node's string, and the number of those pieces.
So a word is read once, byte by byte, and its count is the sum of the numbers popped on the way.
Each word form is counted once per worker's memory; every text is read whole.

Words: white space separates; within, runs of letters, single digits and runs of other marks, in
lower case, each read with an end mark if the vocabulary has one. In a vocabulary with a
continuation prefix, pieces inside a word are looked up with it; a word that cannot be cut
counts as one (unknown) token.

Cases: null and empty texts have no words and no tokens. Every row has a result, repeated rows
and null ids too. An empty table gives no rows. Other columns are not read.
"""

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.tokens import byte_of_character, vocabulary_path

# Never a byte of UTF-8.
END = b"\xff"
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SEEN = 400_000


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings in time linear in their length."""

    def __init__(self, pieces, continuing=()):
        """`pieces` may begin a word; `continuing` may follow, or all if none are given."""
        self._next: dict[int, int] = {}
        self._size = 1
        self._ends: set[int] = set()
        order: list[tuple[int, int, int]] = []
        self._rest = 0
        self._add(pieces, 0, order)
        if continuing:
            self._rest, self._size = self._size, self._size + 1
            self._add(continuing, self._rest, order)
        self._link(order)

    def _add(self, pieces, root, order):
        for piece in pieces:
            at = root
            for byte in piece:
                key = at << 8 | byte
                if key not in self._next:
                    self._next[key] = self._size
                    order.append((at, byte, self._size))
                    self._size += 1
                at = self._next[key]
            if at != root:
                self._ends.add(at)

    def _link(self, order):
        """Failure links and popped counts, parents before their children."""
        fail, popped = [-1] * self._size, [0] * self._size
        depth = [0] * self._size
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        step = self._next.get
        for parent, byte, node in sorted(order, key=lambda edge: depth[edge[2]]):
            if node in self._ends:
                fail[node], popped[node] = self._rest, 1
                continue
            at, count = fail[parent], popped[parent]
            while at >= 0 and (at << 8 | byte) not in self._next:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = step(at << 8 | byte), count
        self._fail, self._popped = fail, popped

    def count(self, word: bytes) -> int | None:
        """Number of pieces, or None if the word cannot be cut."""
        step, fail, popped = self._next.get, self._fail, self._popped
        at = total = 0
        for byte in word:
            while (after := step(at << 8 | byte)) is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return None
            at = after
        while at and at != self._rest:
            total += popped[at]
            at = fail[at]
            if at < 0:
                return None
        return total


def automaton(path: str, end: str = "</w>", prefix: str = "##") -> LongestMatch:
    """From a byte-level vocabulary with end marks, or a word-piece one with a prefix."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = list(model["vocab"])
    if model.get("type") == "WordPiece":
        first = [p.encode() for p in vocabulary if not p.startswith(prefix)]
        return LongestMatch(first, [p.removeprefix(prefix).encode() for p in vocabulary if p.startswith(prefix)])
    to_byte = byte_of_character()
    pieces = []
    for piece in vocabulary:
        body = piece.removesuffix(end) if piece != end else piece
        if all(c in to_byte for c in body):
            pieces.append(bytes(to_byte[c] for c in body) + (END if piece != body else b""))
    return LongestMatch(pieces)


class WordCounts(dict):
    """White-space separated word to its number of tokens."""

    def __init__(self, match: LongestMatch, marked: bool):
        super().__init__()
        self._match, self._end = match, END if marked else b""

    def __missing__(self, word: str) -> int:
        total = 0
        for part in _PARTS.findall(word.lower()):
            found = self._match.count(part.encode("utf-8", "replace") + self._end)
            total += 1 if found is None else found
        if len(word) <= 64:
            self[word] = total
        return total


_COUNTS: dict[tuple, WordCounts] = {}


def word_counts(path: str, end: str) -> WordCounts:
    """One per worker process and vocabulary."""
    if (path, end) not in _COUNTS:
        _COUNTS[path, end] = WordCounts(automaton(path, end), bool(end))
    return _COUNTS[path, end]


def count_tokens(documents: DataFrame, vocabulary: str | None = None, end: str = "</w>",
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_tokens), one per document."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")

    def task(batches):
        counts = word_counts(path, end)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").split()
                if len(counts) > _SEEN:
                    counts.clear()
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                names=["doc_id", "n_words", "n_tokens"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_words long, n_tokens long")
