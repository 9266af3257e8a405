"""How many word pieces a text has, by greedy longest match, without making the pieces.

The vocabulary is a trie. Where a node has no edge for the next sign, the pieces that longest match would
take from what was read so far are popped: their number, and the node for what is left, are fixed for the
node and computed beforehand (failure link and popped count). A word then costs one step per sign and at most
one pop per sign, whatever the pieces are.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from frameops.llm.common import id_and_text

END = 256  # the sign after a word's last byte
WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)(?![^\W\d_])|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Automaton:
    """Longest-match counting over a vocabulary of sign sequences (bytes, and ``END``)."""

    def __init__(self, vocabulary: Iterable[tuple[int, ...]]) -> None:
        self.edges: list[dict[int, int]] = [{}]
        piece = [False]
        for signs in vocabulary:
            node = 0
            for sign in signs:
                to = self.edges[node].get(sign)
                if to is None:
                    to = self.edges[node][sign] = len(self.edges)
                    self.edges.append({})
                    piece.append(False)
                node = to
            piece[node] = node != 0
        self.failure: list[int] = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for sign, child in self.edges[node].items():
                if piece[child]:
                    self.failure[child], self.popped[child] = 0, 1
                else:
                    back, n = self.failure[node], self.popped[node]
                    while back >= 0 and sign not in self.edges[back]:
                        n += self.popped[back]
                        back = self.failure[back]
                    if back >= 0:
                        self.failure[child], self.popped[child] = self.edges[back][sign], n
                todo.append(child)

    def count(self, signs: Iterable[int]) -> int:
        """Pieces of one word; -1 if longest match cannot cover it."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = n = 0
        for sign in signs:
            while sign not in edges[node]:
                n += popped[node]
                node = failure[node]
                if node < 0:
                    return -1
            node = edges[node][sign]
        while node:
            n += popped[node]
            node = failure[node]
            if node < 0:
                return -1
        return n


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, a public convention."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces in a tokenizer file as bytes; a word end in a piece's name is the sign ``END``."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    letters, pieces = byte_letters(), []
    for name in data["model"]["vocab"]:
        if name not in special:
            body = name.removesuffix(word_end)
            pieces.append(tuple(letters[c] for c in body) + ((END,) if body != name else ()))
    return pieces


class Counter:
    """Counts texts; remembers words, within a bound."""

    def __init__(self, automaton: Automaton, most: int = 200_000) -> None:
        self.automaton, self.most, self.known = automaton, most, {}

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.automaton.count([*word.encode("utf-8"), END])
            if len(word) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, pieces, words that cannot be covered); such a word counts as one piece."""
        words = WORD.findall(text.lower())
        counts = list(map(self.word, words))
        unknown = counts.count(-1)
        return len(words), sum(counts) + 2 * unknown, unknown


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), one row per row of ``docs``.

    Texts are lower-cased and split into words: contractions, runs of letters, single digits, runs of other
    signs; white space goes. Null and empty texts have no words. Repeated rows and null ids stay. Only the id
    and the text are read. The vocabulary file must be on every machine.
    """
    rows = id_and_text(docs, id_col, text_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Automaton(load_vocabulary(vocabulary)))
        for part in parts:
            counts = [counter.text(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(batches, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
