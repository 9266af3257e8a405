"""Best-fit packing of token sequences, planned on a histogram of lengths.

The plan is made on the counts of pieces by length, at most as many as a sequence has tokens, so it
costs the same for a thousand documents and for a trillion. It fills sequences from the longest pieces
down, each into the fullest sequence that still has room, many equal sequences at a time. Pieces then
take the planned places: the n-th piece of a length takes the n-th place for that length.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text
from frameops.session import stage

CAPACITY = 1024
END = 2


@dataclass(frozen=True)
class Run:
    """Places for pieces of one length: the first ``count`` ranks from ``rank`` fill sequences from ``sequence``
    on, ``each`` in a sequence, the first at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Places for ``counts[length]`` pieces of each length. The work depends on the capacity, not on the counts."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []  # sorted, those with groups
    runs, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one more sequence takes the rest
                runs.append(Run(length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return runs


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter if there are several."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, length, capacity)]


class Encoder:
    """Token ids of texts by the tokenizer in a file, in one thread.

    If the same vocabulary is given as ranks, texts of ASCII, Latin, Greek and Cyrillic letters are encoded
    from those, which is some five times as fast and gives the same ids; all others by the tokenizer itself.
    """

    FAST_BELOW = "\u0530"

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and (not text or max(text) < self.FAST_BELOW):
            try:
                return self.fast.encode(text, allowed_special="all")
            except (ValueError, RuntimeError):  # its pattern engine gives up on some very long runs
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, place): a row per piece of every document.

    ``ids`` are little-endian unsigned 32-bit ids. A document is its whole text's ids and ``end``; null counts
    as empty and is one piece of one id. ``task`` and ``place`` number the pieces of a length as they are made;
    write the pieces (``place_pieces`` does) before using them twice.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId()
        places = [0] * (capacity + 1)
        for part in parts:
            of, rows, blobs = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = encoder.ids(text)
                ids.append(end)
                blob = np.array(ids, dtype="<u4").tobytes()
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    of.append(i)
                    rows.append((piece, start, length, places[length]))
                    blobs.append(blob[4 * start : 4 * (start + length)])
                    places[length] += 1
            piece, start, length, place = (np.array(rows, dtype=np.int64).reshape(-1, 4)[:, i] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(of, pa.int64())),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(blobs, pa.binary()),
                    pa.array(np.full(len(of), task, dtype=np.int64)),
                    pa.array(place),
                ],
                ["doc_id", "piece", "start", "length", "ids", "task", "place"],
            )

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, task bigint, place bigint"
    return rows.mapInArrow(batches, schema)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``pieces`` but ``task`` and ``place``, with ``sequence_id`` and ``offset``.

    ``pieces`` has ``length`` (1 to ``capacity``), ``task`` and ``place`` as ``token_pieces`` makes them. Offsets in
    a sequence have no gaps. No pieces give no rows. Leave ids out of ``pieces``, or join them back, where they
    need not be moved: the rows are written once and shuffled once.
    """
    pieces = stage(pieces, "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, np.ndarray] = {}
    for run in plan_best_fit(totals, capacity):
        by_length.setdefault(run.length, []).append((run.rank, run.sequence, run.each, run.offset))
    by_length = {k: np.array(v, dtype=np.int64).T for k, v in by_length.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(by_length)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for part in parts:
            length, rank = (part.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, start, each, base = runs[int(one)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[run]
                sequence[at] = start[run] + nth // each[run]
                offset[at] = base[run] + nth % each[run] * one
            kept = part.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    kept = [c for c in pieces.columns if c not in ("task", "place")]
    # A merge join: there are counts for every task, so neither side has a bound.
    ranked = pieces.join(counts.select("length", "task", "ahead").hint("merge"), ["length", "task"])
    ranked = ranked.select(*kept, (F.col("ahead") + F.col("place")).alias("rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(batches, schema)
