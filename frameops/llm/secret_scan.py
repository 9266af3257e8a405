"""Secrets in texts: three known shapes, and runs of characters too random to be words.

The known shapes are regular expressions. Everything else is found by entropy: a candidate
is a maximal run of token characters; a window slides over it and counts of its characters
are updated by one character in and one out, with the sum of ``n log2 n`` kept beside them,
so each step costs the same however wide the window is. The window's Shannon entropy is held
against two thresholds of the candidate's character class: above the higher it needs no other
evidence; above the lower, which nearly all random windows of that alphabet and length pass, it
needs digits and changes between digits and letters, and between letter cases, as random ones have. A run may hold several things joined
by signs: known shapes and what the allow list matches are cut out of it, and what is left is
scanned as a whole and, each by its own class, in its parts between the signs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from frameops.llm.common import id_and_text, per_text

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}", re.ASCII)
# A text that has none of these, in lower case, has no assignment.
KEYWORDS = ("passw", "secret", "token", "api")
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}", re.ASCII)
PART = re.compile(rf"[A-Za-z0-9]{{{LEAST},}}", re.ASCII)
WORD_START, WORD_END = re.compile(r"[A-Za-z0-9]*"), re.compile(r"[A-Za-z0-9]*$")

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Class:
    """A character class: what its windows must have. Entropies are in bits per character."""

    name: str
    pattern: str
    width: int
    most: float  # entropy that is enough alone
    least: tuple[float, ...]  # entropy that is enough with the changes, for windows of LEAST, LEAST + 1 ... characters
    changes: int  # changes of kind (digit, small, capital; signs aside), with a digit; none are asked for if 0

    def least_of(self, size: int) -> float:
        return self.least[min(max(size - LEAST, 0), len(self.least) - 1)]


@dataclass(frozen=True)
class Classes:
    """Character classes from narrow to wide. The lower entropies are 1 % quantiles of uniformly random windows."""

    windows: tuple[Class, ...] = (
        Class("decimal", r"[0-9]+", 24, 3.1, (2.50, 2.52, 2.56, 2.59, 2.62), 0),
        Class("hexadecimal", r"[0-9a-fA-F]+", 24, 3.2, (2.88, 2.92, 2.97, 3.00, 3.04), 4),
        Class("small alphanumeric", r"[a-z0-9]+", 20, 3.9, (3.40,), 3),
        Class("capital alphanumeric", r"[A-Z0-9]+", 20, 3.9, (3.40,), 3),
        Class("alphanumeric", r"[A-Za-z0-9]+", 20, 3.9, (3.64,), 6),
        Class("base64", r"[A-Za-z0-9+/_=-]+", 20, 4.0, (3.64,), 6),
    )


@dataclass(frozen=True)
class AllowList:
    """What looks random but is no secret. Matches are cut out of a run; ``^`` and ``$`` are the ends of what is scanned."""

    patterns: tuple[str, ...] = (
        r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9a-zA-Z])",  # UUID
        r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",  # of a provider's manual
        r"(?i)example|sample|dummy|placeholder|changeme|redacted",
        r"^[A-Za-z]+(?:[-_/][A-Za-z]+)+$",  # words joined by signs, paths
        r"^[-_=+/]+$",  # rules
        r"(?i)abcdefghijklmnop|0123456789",
    )


def max_entropy_span(
    run: str, width: int, most: float, least: float | None = None, changes: int = 0
) -> tuple[int, int] | None:
    """The union of the windows of ``run`` that are random, from the first to the last.

    Those have an entropy of ``most``, or of ``least`` with that many changes of kind and a digit.
    A run shorter than the window is one window.
    """
    size = min(width, len(run))
    # A character comes in before one goes out, so there may be one more than the window holds.
    cost = [0.0] + [n * math.log2(n) for n in range(1, size + 2)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n over the characters in the window
    first = last = -1
    # Entropy is log2(size) - total / size, so the tests are on the total alone.
    alone = size * (math.log2(size) - most) + 1e-9
    helped = alone if least is None else size * (math.log2(size) - least) + 1e-9
    changed, digits = kinds_of(run) if least is not None and changes else ([], [])
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if i >= size:
            out = run[i - size]
            n = counts[out]
            counts[out] = n - 1
            total += cost[n - 1] - cost[n]
        if i < size - 1 or total > max(alone, helped):
            continue
        a = i - size + 1
        # Up to a character, so that a difference is what the window has after its first one.
        if total <= alone or not changes or (changed[i] - changed[a] >= changes and digits[i + 1] > digits[a]):
            first = a if first < 0 else first
            last = i + 1
    return None if first < 0 else (first, last)


def kinds_of(run: str) -> tuple[list[int], list[int]]:
    """Changes of kind up to each character, itself included, and digits before each and in all."""
    changed, digits, before = [], [0], ""
    for c in run:
        kind = "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else before
        changed.append((changed[-1] if changed else 0) + (kind != before and before != ""))
        digits.append(digits[-1] + ("0" <= c <= "9"))
        before = kind
    return changed, digits


class Scanner:
    """Finds all spans of one text; made once per task."""

    def __init__(self, classes: Classes, allow: AllowList) -> None:
        self.classes = [(re.compile(c.pattern, re.ASCII), c) for c in classes.windows]
        self.allow = [re.compile(p) for p in allow.patterns]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rank of the kind, end) of all spans, sorted; the known shapes leftmost, without overlap per kind."""
        found = []
        lower = text.lower()
        if any(word in lower for word in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        runs = list(CANDIDATE.finditer(text))
        for run in runs:  # hexadecimal digits are token characters, so a long row of them is inside a run
            found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text, run.start(), run.end())]
        known = sorted((a, b) for a, _, b in found)
        at = 0
        for run in runs:
            while at < len(known) and known[at][1] <= run.start():
                at += 1
            cuts, i = [], at
            while i < len(known) and known[i][0] < run.end():
                cuts.append(known[i])
                i += 1
            found += [(a, 3, b) for piece in left_of(run.start(), run.end(), cuts) for a, b in self.random(text, *piece)]
        return sorted(found)

    def random(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """The random spans of ``text[start:end]``, sorted and without overlap."""
        pieces = [(start, end)]
        for pattern in self.allow:
            pieces = [p for a, b in pieces for p in left_of(a, b, matches(pattern, text, a, b))]
        spans = []
        for a, b in pieces:
            parts = {(a, b), *(m.span() for m in PART.finditer(text, a, b))}
            spans += [s for p in parts if (s := self.random_span(text, *p))]
        joined: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if joined and a < joined[-1][1]:
                joined[-1] = joined[-1][0], max(b, joined[-1][1])
            else:
                joined.append((a, b))
        return joined

    def random_span(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The random span of one piece, out to the ends of a word it begins or ends in, if less than a window away."""
        run = text[start:end]
        kind = next(c for p, c in self.classes if p.fullmatch(run))
        span = max_entropy_span(run, kind.width, kind.most, kind.least_of(min(kind.width, len(run))), kind.changes)
        if span is None:
            return None
        a, b = span
        before, after = WORD_END.search(run[max(a - kind.width, 0) : a]), WORD_START.match(run, b, b + kind.width)
        a -= len(before[0]) if run[a].isalnum() and len(before[0]) < kind.width else 0
        b += len(after[0]) if run[b - 1].isalnum() and len(after[0]) < kind.width else 0
        return start + a, start + b


def matches(pattern: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the pattern matches in ``text[start:end]``, taken alone."""
    return [(start + m.start(), start + m.end()) for m in pattern.finditer(text[start:end]) if m[0]]


def left_of(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted cuts leave of a run of the text: pieces that are long enough."""
    pieces = []
    for a, b in [*cuts, (end, end)]:
        if a - start >= LEAST:
            pieces.append((start, a))
        start = max(start, b)
    return pieces


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: Classes = Classes(),
    allow: AllowList = AllowList(),
) -> DataFrame:
    """(doc_id, spans): every secret of every whole text, by start, then kind as in ``KINDS``.

    Spans are in code points, the end exclusive. Null and empty texts have no spans; repeated rows
    and null ids come out as they went in, one row each. Texts of any length are read once. Only the
    id and the text column are read, so other columns cannot clash.
    """

    def work():
        scanner = Scanner(classes, allow)
        return lambda texts: [
            [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts]
        ]

    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return per_text(rows, f"doc_id {kind}, spans {SPANS}", ["doc_id"], work)


def redact(text: str | None, scanner: Scanner, mask: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by a mask."""
    spans = scanner.spans(text) if text else []
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(
    docs: DataFrame,
    text_col: str = "text",
    classes: Classes = Classes(),
    allow: AllowList = AllowList(),
    mask: str = "[REDACTED]",
) -> DataFrame:
    """``docs`` with all its columns and rows, the secrets in its texts masked. Null texts stay null."""
    import pyarrow as pa

    def batches(parts):
        scanner = Scanner(classes, allow)
        for part in parts:
            at = part.schema.names.index(text_col)
            texts = [redact(t, scanner, mask) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, type=part.schema.field(at).type))

    return docs.mapInArrow(batches, docs.schema)
