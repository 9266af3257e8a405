"""Benchmark passages in training texts.

A benchmark item's windows of 13 words are a hash set that every task holds; a document's words slide
past it. Only every seventh position of a document is looked up, with the seven words there: a window of
13 words always covers one such position, and the pieces of seven words of all windows are a hash set
too. Around a hit, the whole windows are looked up.

The set is broadcast in blocks of benchmark items whose text has a bounded size; every block is one scan
of the documents, and only documents with hits go on, to be merged over the blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text, text_of
from frameops.session import stage

WINDOW = 13
# Bytes of benchmark text whose windows one broadcast may hold; the set takes some 20 times as much.
BLOCK_BYTES = 4 << 20

# A-Z to a-z; other bytes below 128 that are neither a digit nor a small letter to a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and anything outside ASCII."""
    return text.encode("utf-8").translate(_WORDS).split()


@dataclass
class WindowSet:
    """The windows of some items: by length, window -> items; for whole windows also their parts."""

    size: int = WINDOW
    full: dict[bytes, list] = field(default_factory=dict)
    short: dict[int, dict[bytes, list]] = field(default_factory=lambda: defaultdict(dict))
    parts: set[bytes] = field(default_factory=set)

    @property
    def stride(self) -> int:
        return (self.size + 1) // 2

    def add(self, item: str, text: str) -> None:
        words = words_of(text)
        if 0 < len(words) < self.size:
            self.short[len(words)].setdefault(b" ".join(words), []).append(item)
        part = self.size - self.stride + 1
        for i in range(len(words) - self.size + 1):
            window = words[i : i + self.size]
            of = self.full.setdefault(b" ".join(window), [])
            if not of or of[-1] != item:
                of.append(item)
        if len(words) >= self.size:
            self.parts.update(b" ".join(words[i : i + part]) for i in range(len(words) - part + 1))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of all occurrences, joined and in order, and the items that occur."""
        if not words:
            return [], set()
        joined = b" ".join(words)
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        found, items, n = [], set(), len(words)
        part, size = self.size - self.stride + 1, self.size
        if self.full:
            near = [
                i for i in range(0, n - part + 1, self.stride) if joined[starts[i] : starts[i + part] - 1] in self.parts
            ]
            done = 0
            for i in near:
                for at in range(max(done, i - size + part, 0), min(i, n - size) + 1):
                    of = self.full.get(joined[starts[at] : starts[at + size] - 1])
                    if of:
                        found.append((at, at + size))
                        items.update(of)
                done = max(done, i + 1)
        for length, known in self.short.items():
            for at in range(n - length + 1):
                of = known.get(joined[starts[at] : starts[at + length] - 1])
                if of:
                    found.append((at, at + length))
                    items.update(of)
        return join_ranges(found), items


def join_ranges(ranges: list) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one each, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def window_blocks(
    benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int
) -> Iterator[WindowSet]:
    """The windows of all items in blocks of at most ``block_bytes`` of text, or one item if it is longer."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")), text_of(text_col))
    block, held = WindowSet(size), 0
    for item, text in rows.toLocalIterator():
        if held and held + len(text) * 4 > block_bytes:
            yield block
            block, held = WindowSet(size), 0
        block.add(item, text)
        held += len(text.encode("utf-8"))
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, ranges, items) for every row of ``docs``.

    ``ranges`` are the word ranges [start, end) inside any occurrence of a window, joined where they touch;
    ``items`` the distinct ids, sorted as strings, of the items that occur. An item shorter than the window
    is one window; an item without words has none. Null texts have no words; a null item id counts as the
    empty string. Rows that repeat come out as often as they went in, and an empty table as an empty table.
    With several blocks the hits of a document meet by id and text hash.
    """
    rows = id_and_text(docs, id_col, text_col)
    spark, kind = docs.sparkSession, dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, ranges array<struct<start:bigint,end:bigint>>, items array<string>"

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def scan(block: WindowSet) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for part in parts:
                n, ranges, items = [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    found, of = windows.hits(words)
                    n.append(len(words))
                    ranges.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(of))
                made = [pa.array(n, pa.int64()), pa.array(ranges, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
                kept = [x for x in part.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(x) for x in kept] + made, [*kept, "n_words", "ranges", "items"]
                )

        return rows.mapInArrow(batches, schema)

    blocks = window_blocks(benchmark, item_col, item_text_col, size, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scan(first)

    # Rows of one id and text have the same hits, so those of all blocks meet by id and a hash of the text.
    rows = rows.withColumn("text_hash", F.xxhash64("text", F.length("text")))
    schema = schema.replace("n_words", "text_hash bigint, n_words")
    scans = [scan(block) for block in chain([first, second], blocks)]
    key = ["doc_id", "text_hash"]
    hit = [df.filter(F.size("ranges") > 0).dropDuplicates(key) for df in scans]
    merged = hit[0]
    for df in hit[1:]:
        merged = merged.unionAll(df)
    merged = merged.groupBy(*key).agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.udf(lambda x: join_ranges(x or []), "array<struct<start:bigint,end:bigint>>")
    base, m = scans[0].select(*key, "n_words"), merged.select(
        F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "ranges", "items"
    )
    both = base.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", joined("ranges").alias("ranges"), F.coalesce("items", none).alias("items"))


def contaminated(n_words: int, n_hit: int) -> bool:
    """At least one word in twenty is inside a benchmark passage."""
    return n_hit > 0 and 20 * n_hit >= n_words


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with all its columns: contaminated documents go, fewer hits are cut out of the text.

    A document is contaminated if at least one word in twenty is inside an occurrence of a window, judged on
    the text as it comes in. Otherwise the characters from the first to the last word of each hit range are
    removed. Documents without hits, null texts included, stay as they are.
    """
    spark = docs.sparkSession
    name = next(x for i in range(99) if (x := f"hits_{i}") not in {c.lower() for c in docs.columns})
    span = "array<struct<start:bigint,end:bigint>>"
    rows = docs.withColumn(name, F.array().cast(span))
    blocks = window_blocks(benchmark, item_col, item_text_col, size, block_bytes)
    block, following = next(blocks), next(blocks, None)
    while following is not None:  # each pass adds one block's hits to every row
        rows = stage(rows.mapInArrow(_pass(spark, block, text_col, name, False), rows.schema), "hits")
        block, following = following, next(blocks, None)
    return rows.mapInArrow(_pass(spark, block, text_col, name, True), docs.schema)


def _pass(spark: SparkSession, block: WindowSet, text_col: str, name: str, last: bool):
    shared = spark.sparkContext.broadcast(block)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for part in parts:
            at, hits_at = part.schema.names.index(text_col), part.schema.names.index(name)
            texts, hits, keep = [], [], []
            for text, before in zip(part.column(at).to_pylist(), part.column(hits_at).to_pylist(), strict=True):
                words = words_of(text or "")
                found = join_ranges(windows.hits(words)[0] + [(x["start"], x["end"]) for x in before])
                hits.append([{"start": a, "end": b} for a, b in found])
                keep.append(not contaminated(len(words), sum(b - a for a, b in found)))
                texts.append(cut_words(text, found) if found and keep[-1] else text)
            if last:
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                part = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [c for i, c in enumerate(part.columns) if i != hits_at],
                    [c for i, c in enumerate(part.schema.names) if i != hits_at],
                )
            else:
                yield part.set_column(hits_at, part.schema.field(hits_at), pa.array(hits, part.schema.field(hits_at).type))

    return batches


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each range."""
    raw = text.encode("utf-8")
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8")
