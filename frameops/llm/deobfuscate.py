"""Restoring obfuscated words with a noisy channel: leetspeak, spaced letters, stretched letters.

What stands in a text is taken as a hidden text that went through a channel. Each sign of a noisy
stretch is a column of a lattice: the letters it may stand for, nothing (a repeated letter, or a sign
between spaced letters), or a word boundary. A trigram model of letters weighs the paths and Viterbi
decoding takes the best one. What stands there, signs aside, is always one of the paths, so the model decides.
Only numbers and long hexadecimal, by their shape, and words without a sign or a doubled letter are not decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
EDGE, OTHER = 0, len(LETTERS) + 1  # a word's edge, and any letter outside the alphabet
SIZE = len(LETTERS) + 2
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
BYTE_CODES = bytes(CODE.get(chr(i), EDGE) for i in range(256))

# The letters that a sign commonly stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}

WORD = re.compile(f"[{LETTERS}]+")
# Signs and single letters in turns, three letters at least, any gap between: "i d i o t", "i.d.i.o.t", one a line.
BETWEEN = ".-_*/~,;:=#&^\\·•"
_GAP = r"\s" + re.escape(BETWEEN)
SPACED = re.compile(
    r"(?<![^\s\"'(\[{<“”„«»‘’¡*_~])(?<!\w['’*_~])(?:[^\W_]|[@$!|+(€£¡])"
    rf"(?:[{_GAP}]++[^{_GAP}]){{2,}}(?=[{_GAP}?!\")\]}}>“”»…]|['’](?!\w)|$)"
)
DOUBLE = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SIGNS = re.compile(r"[0-9@$!|+(€£¡]")
NOISE = re.compile(rf"{SIGNS.pattern}|{DOUBLE.pattern}")
NUMBER = re.compile(r"[+$€£(|]*\d+(?:[.,:/+\-*=()|]+\d+)*[$€£+!|)]?")
HEX = re.compile(r"(?=.*\d)[0-9a-f-]{16,}")
NO_LETTERS = re.compile(r"[0-9@$!|+(€£¡]{3,}")
BETWEEN_PARTS = re.compile(r"[^\w@$!|+(€£¡]+|_+")
OUTER = ".,;:?\"'()[]{}<>“”„«»…"
# Signs of OUTER that may also be a letter, by where they stand as punctuation.
OPENING, CLOSING = "(¡", "!"


@dataclass(frozen=True)
class Channel:
    """Costs, in nats, of what the channel does to a letter."""

    leet: float = 2.0
    keep_sign: float = 6.0
    repeat: float = 0.7
    double: float = 3.0  # repeat, where the letter stands twice only
    punctuation: float = 1.0  # a bracket or mark at its usual end of a word
    spacing: float = 0.3
    boundary: float = 2.5


def trigram_counts(words: Counter) -> np.ndarray:
    """Counts of letter trigrams, edges included, over counted words."""
    counts = np.zeros(SIZE**3, dtype=np.int64)
    codes, weights = [], []
    for word, n in words.items():
        a = b = EDGE
        for c in [*(CODE.get(x, OTHER) for x in word), EDGE]:
            codes.append((a * SIZE + b) * SIZE + c)
            weights.append(n)
            a, b = b, c
    np.add.at(counts, np.array(codes, dtype=np.int64), np.array(weights, dtype=np.int64))
    return counts


def text_trigrams(texts: Iterable[str], block: int = 1 << 20) -> np.ndarray:
    """``trigram_counts`` of all words of texts, by arrays of about ``block`` letters, a longer text in pieces."""
    counts, held, size = np.zeros(SIZE**3, dtype=np.int64), [], 0

    def add() -> None:
        # A letter is one byte of Latin-1; all else becomes an edge.
        signs = "\n".join(["", "", *held, ""]).lower().encode("latin-1", "replace")
        codes = np.frombuffer(signs.translate(BYTE_CODES), dtype=np.uint8)
        for at in range(0, len(codes) - 2, block):
            a, b, c = (codes[at + k : min(at + block, len(codes) - 2) + k] for k in range(3))
            # What stands before an edge is no part of the word.
            grams = (a * (b != EDGE)).astype(np.int32)
            counts[:] += np.bincount((grams * SIZE + b) * SIZE + c, minlength=SIZE**3)

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= block:
            add()
            held, size = [], 0
    add()
    counts[EDGE] = 0  # edges after edges are no trigrams
    return counts


class LetterModel:
    """Costs (negative log probabilities) of a letter after two others, smoothed with pairs and singles."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        flat = (one + 1) / (one.sum() + SIZE)
        pair = (two + 5 * flat) / (two.sum(1, keepdims=True) + 5)
        self.cost = (-np.log((three + 5 * pair) / (three.sum(2, keepdims=True) + 5))).tolist()


def is_gap(sign: str) -> bool:
    return sign in BETWEEN or sign.isspace()


def parts_of(core: str) -> list[str]:
    """The stretches of letters and signs that stand for letters."""
    return [p for p in BETWEEN_PARTS.split(core) if p]


@dataclass
class Restorer:
    """Restores texts; remembers words it has seen, within a bound."""

    model: LetterModel
    channel: Channel = field(default_factory=Channel)
    most: int = 200_000
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def decode(self, noisy: str, spaced: bool) -> list[str]:
        """The words of the best path through the lattice of a noisy stretch (lower case)."""
        return self.best(noisy, spaced)[1]

    def best(self, noisy: str, spaced: bool) -> tuple[float, list[str]]:
        """Cost and words of the best path."""
        cost, ch = self.model.cost, self.channel
        read = [x for x in noisy if not (spaced and is_gap(x))]
        repeats = (
            ch.repeat if n > 2 else ch.double
            for n in (len(list(same)) for _, same in groupby(read, lambda x: LEET.get(x, x)[0]))
            for _ in range(n)
        )
        # Per pair of last letters: cost, path as a chain of (letter, path before it).
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for x in noisy:
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(key, value, path, nxt=nxt):
                if key not in nxt or value < nxt[key][0]:
                    nxt[key] = (value, path)

            code = CODE.get(x, OTHER)
            spacing = spaced and is_gap(x)
            repeat = 0.0 if spacing else next(repeats)
            for (a, b), (so_far, path) in best.items():
                if spacing:
                    offer((a, b), so_far + ch.spacing, path)
                    if b != EDGE:
                        offer((EDGE, EDGE), so_far + ch.boundary + cost[a][b][EDGE], (" ", path))
                    continue
                if x.isalpha():
                    offer((b, code), so_far + cost[a][b][code], (x, path))
                    if path is not None and path[0] == x:
                        offer((a, b), so_far + repeat, path)
                    continue
                for letter in LEET.get(x, ""):
                    to = CODE[letter]
                    offer((b, to), so_far + ch.leet + cost[a][b][to], (letter, path))
                    if path is not None and path[0] == letter:
                        offer((a, b), so_far + ch.leet + repeat, path)
                # The sign stands for itself and ends the word.
                edge = cost[a][b][EDGE] if b != EDGE else 0.0
                offer((EDGE, EDGE), so_far + ch.keep_sign + edge, (" ", path))
            best = nxt
        end = min((v + (cost[a][b][EDGE] if b != EDGE else 0.0), i) for i, ((a, b), (v, _)) in enumerate(best.items()))
        path, letters = list(best.values())[end[1]][1], []
        while path is not None:
            letters.append(path[0])
            path = path[1]
        return end[0], "".join(reversed(letters)).split()

    def token(self, token: str) -> tuple[str, ...]:
        """The restored words of one run without white space (lower case)."""
        found = self.known.get(token)
        if found is None:
            found = self.decoded(token)
            if len(token) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = found
        return found

    def decoded(self, token: str) -> tuple[str, ...]:
        if not NOISE.search(token):
            return tuple(WORD.findall(token))
        core = token.strip(OUTER)
        if not core or NUMBER.fullmatch(core) or HEX.fullmatch(core):
            return tuple(WORD.findall(core))
        at = token.index(core)
        core = self.with_ends(token[:at][-1:], core, token[at + len(core) :][:1])
        if not any(c.isalpha() for c in core):
            noisy = NO_LETTERS.fullmatch(core) and len(set(core)) > 1
        else:
            noisy = SIGNS.search(core) or TRIPLE.search(core)
        if noisy:
            return tuple(w for p in parts_of(core) for w in self.decode(p, False))
        return tuple(DOUBLE.sub(self.once_or_twice, w) for w in WORD.findall(core))

    def once_or_twice(self, m: re.Match) -> str:
        """A doubled letter, once if that is likelier. The best path through the lattice of a word whose only noise
        are doubled letters: what stays of one pair does not change the letters next to another."""
        cost, word, (i, j) = self.model.cost, m.string, m.span()
        a, b, c = (EDGE if k < 0 or k == len(word) else CODE[word[k]] for k in (i - 1, i, j))
        return m[1] if cost[a][b][b] + cost[b][b][c] > cost[a][b][c] + self.channel.double else m[0]

    def with_ends(self, before: str, core: str, after: str) -> str:
        """The core, with the sign before and after it if that is likelier a letter than punctuation."""
        parts, ch = parts_of(core), self.channel
        if not parts:
            return core

        def letter(part: str, whole: str, usual: bool) -> bool:
            plain = self.best(part, False)[0] + (ch.punctuation if usual else ch.keep_sign)
            return self.best(whole, False)[0] < plain

        first, last = parts[0], parts[-1]
        begins = before != "" and before in OPENING + CLOSING and core.startswith(first)
        ends = after != "" and after in CLOSING and core.endswith(last)
        if begins and letter(first, before + first, before in OPENING):
            core = before + core
        if ends and letter(last, last + after, True):
            core += after
        return core

    def split(self, text: str) -> tuple[list[tuple[str, ...]], list[str]]:
        """The restored words of a text's spaced stretches, and its other runs of signs (lower case)."""
        groups = []

        def take(m: re.Match) -> str:
            if not any(c.isalpha() or c in LEET and not c.isdigit() for c in m[0]):
                return m[0]  # a row of numbers
            groups.append(tuple(self.decode(m[0], True)))
            return " "

        text = SPACED.sub(take, text.lower())
        return groups, text.split()

    def words(self, text: str) -> list[tuple[str, ...]]:
        """The restored words of a text, a group per run of signs."""
        groups, tokens = self.split(text)
        return groups + list(map(self.token, tokens))

    def restore(self, text: str) -> str:
        """The restored text, words joined by spaces."""
        return " ".join(w for group in self.words(text) for w in group)


