"""Runs of repeated words, by a dictionary of basic factors.

For every power of two, positions get the name of the factor of that many words that starts there; a name is made
of the names of the two halves. Occurrences of a factor whose next occurrence is at most twice its length away and
which go on at the same step are an arithmetic progression, and the step is proposed as a period. Proposals are
extended word by word as far as the period holds and counted once. A position whose factor does not occur again
near enough for any run is left out of the longer factors.

Texts of an Arrow batch are worked on together, some hundred thousand words at a time, as one sequence of numbers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text

WORDS_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Least:
    """What counts as a run: so many words, and so many times its period, at least."""

    words: int = 6
    exponent: int = 4


def proposals(words: np.ndarray, ends: np.ndarray, least: Least) -> set[tuple[int, int]]:
    """(position, period) pairs that cover every run of ``words``, numbers of words of texts put one after the other.

    ``ends`` has for each position the end of its text.
    """
    found: set[tuple[int, int]] = set()
    # No run of a text has a longer period.
    reach = np.empty(len(words), dtype=np.int64)
    starts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(words) else np.empty(0, dtype=np.int64)
    for a in starts:
        reach[a : ends[a]] = (ends[a] - a) // least.exponent
    at = np.arange(len(words))
    names = np.full(len(words) + 1, -1, dtype=np.int64)  # of all positions; -1 is left out
    names[:-1] = words
    length = 1
    while len(at):
        key = names[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = np.append(key[1:] == key[:-1], False)
        step = np.zeros(len(at), dtype=np.int64)
        step[:-1] = np.where(same[:-1] & (ends[at[:-1]] == ends[at[1:]]), at[1:] - at[:-1], 0)
        step[step > reach[at]] = 0  # also of the next occurrence's text: it is the same
        # Three occurrences at one step, no more than twice the length of the factor.
        going_on = np.flatnonzero((step[:-1] > 0) & (step[:-1] == step[1:]) & (step[:-1] <= 2 * length))
        if len(going_on):
            # Of neighbouring positions with the same step only the first is extended. A run has so many of them
            # at the length next to its period, where no nearer occurrence comes between.
            p, q = at[going_on], step[going_on]
            by = np.lexsort((p, q))
            p, q = p[by], q[by]
            first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)))
            many = np.diff(np.append(first, len(p)))
            first = first[many > np.maximum(least.words - 4 * q[first], 0) + (least.exponent - 2) * q[first] - length]
            found.update(zip(p[first].tolist(), q[first].tolist(), strict=True))
        near = step > 0
        near[1:] |= step[:-1] > 0
        named = np.cumsum(np.append(True, ~same[:-1]))
        alive = np.flatnonzero(near)
        names.fill(-1)
        names[at[alive]] = named[alive]
        at = np.sort(at[alive])
        # The factor of twice the length: both halves are there and in the text.
        at = at[at + 2 * length <= ends[at]]
        at = at[names[at + length] >= 0]
        joined = names[at] * (len(words) + 1) + names[at + length]
        names.fill(-1)
        names[at] = joined
        length *= 2
    return found


def _extend(words: np.ndarray, start: int, end: int, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at``, within a text, whose words are those ``period`` before; looks further and
    further ahead, so the work is in proportion to the stretch."""
    right, some = at, 16
    while right < end - period:
        stop = min(right + some, end - period)
        off = np.flatnonzero(words[right:stop] != words[right + period : stop + period])
        if len(off):
            right += int(off[0])
            break
        right, some = stop, some * 2
    left, some = at, 16
    while left > start:
        stop = max(left - some, start)
        off = np.flatnonzero(words[stop:left] != words[stop + period : left + period])
        if len(off):
            left = stop + int(off[-1]) + 1
            break
        left, some = stop, some * 2
    return left, right + period


def find_runs(texts: list[np.ndarray], least: Least = Least()) -> list[list[tuple[int, int, int]]]:
    """Per text, given as numbers of words, its runs (start, length, period) by start, then period."""
    if not texts:
        return []
    words = np.concatenate(texts)
    cuts = np.cumsum([0, *map(len, texts)])
    ends = np.repeat(cuts[1:], np.diff(cuts))
    found: list[set] = [set() for _ in texts]
    done = (0, 0)  # a period, and up to where it is extended
    for at, period in sorted(proposals(words, ends, least), key=lambda x: (x[1], x[0])):
        if period == done[0] and at < done[1]:
            continue
        of = int(np.searchsorted(cuts, at, side="right")) - 1
        start, end = _extend(words, int(cuts[of]), int(cuts[of + 1]), at, period)
        done = (period, end - period)
        if end - start >= max(least.words, least.exponent * period):
            found[of].add((start - int(cuts[of]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def words_of(text: str) -> list[bytes]:
    """What ASCII white space separates, in UTF-8."""
    return text.encode().split()


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The words of some texts as numbers, equal words as equal numbers."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return [np.array([known[w] for w in words], dtype=np.int64) for words in texts]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, of about a tenth of the ids with a repetition at the end. A null id leaves them as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by spaces, without those that some run has after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(kept).decode()


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: Least = Least(), plant: bool = False
) -> DataFrame:
    """(doc_id, runs, collapsed) for every row: the runs (start, length, period) of the text by start, then period,
    and its words, joined by single spaces, without the repeated ones.

    Words are what ASCII white space separates, compared as they are. A run is a stretch with that smallest period,
    ``least.words`` and ``least.exponent`` periods long or longer, that no neighbouring word extends. Null and empty
    texts have no words and no runs; repeated rows and ids are rows of their own; other columns are not read; an
    empty table gives no rows. ``plant`` first makes the repetitions of ``planted``, a test of the operator on any
    table of integer ids.
    """
    rows = id_and_text(docs, id_col, text_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            at = 0
            while at < len(ids):
                some, n, first = [], 0, at
                while at < len(ids) and (n < WORDS_AT_ONCE or not some):
                    words = words_of(texts[at])
                    if plant:
                        words = planted(ids[at], words)
                    some.append(words)
                    n, at = n + len(words), at + 1
                runs = find_runs(numbered(some), least)
                kept = [collapse(w, r) for w, r in zip(some, runs, strict=True)]
                named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(first, at - first), pa.array(named, RUN_TYPE), pa.array(kept, pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    return rows.mapInArrow(batches, f"doc_id {dict(rows.dtypes)['doc_id']}, {RUNS}")


RUN_TYPE = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def run_digest(runs: Column) -> Column:
    """Hex SHA-256 of ``start,length,period`` and a line feed of every run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform(runs, lambda r: F.concat(line(r), F.lit("\n")))
    return F.sha2(F.concat_ws("", lines).cast("binary"), 256)


def longest_run(runs: Column) -> Column:
    """The longest run, of equally long ones the first, then that of the smallest period; null if there is none."""
    fields = lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"], r["length"])
    return F.array_min(F.transform(runs, fields))
