"""Repeated passages: every byte inside a 100-byte string that also begins earlier in the collection.

A 100-byte window is represented by its anchor, the 16-byte piece in it with the least hash, so equal windows
have the same anchor at the same offset. The windows around one anchor are a region, some 140 bytes; a text has
a region for some 40 bytes. What is compared stays small that way: regions meet by their anchor's hash, regions
that are equal altogether are settled by digest, and where an anchor has several different regions these are a
collection for the column-wise construction of ``collection_bwt``, which compares them byte by byte.

Texts are shuffled twice, to cut those regions out and to cut the repeats out; all else is some 40 bytes a region.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.llm.collection_bwt import repeated_windows
from frameops.session import shuffle_partitions, stage

WINDOW = 100
ANCHOR = 16
CHUNK = 8 << 20
# Different regions of an anchor that one construction takes, at some 400 bytes each; and the number of regions
# from which an anchor is worth being split over tasks.
HOT = 250_000
# Regions that one construction takes at a time.
COLLECTION = 20_000
NO_ID = (1 << 63) - 1

REGION = "h bigint, g bigint, doc bigint, th bigint, pack bigint"
SETTLED = "again h doc th pack"
_POSITION = np.uint64((1 << 24) - 1)


def _mixed(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each piece of ``size`` (a power of two) bytes."""
    with np.errstate(over="ignore"):
        h = raw.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        n, factor = 1, np.uint64(0x9E3779B97F4A7C15)
        while n < size:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor, 2 * n
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def regions(raw: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor's place, first and last window start) of each region of a text, in order."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(raw) - window + 1, 0), CHUNK):
        chunk = np.frombuffer(raw, np.uint8, min(CHUNK + window - 1, len(raw) - at), at)
        h = _mixed(chunk, anchor)
        least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, window - anchor + 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if rest := width - size:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & _POSITION).astype(np.int64)  # per window start
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        for out, x in zip(found, (h[place[first]].view(np.int64), place[first] + at, first + at, last + at), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in found)


def _pack(place, first, last):
    return place << 16 | (place - first) << 8 | (place - last)


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = pack >> 16
    return place, place - (pack >> 8 & 255), place - (pack & 255)


def _region_batches(window: int, anchor: int, made: Callable) -> Callable:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, th, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                h, place, first, last = regions(raw, window, anchor)
                if not len(h):
                    continue
                pack = _pack(place, first, last)
                spans = zip(first.tolist(), (last + window).tolist(), (pack & 0xFFFF).tolist(), strict=True)
                g = np.array([xxhash.xxh64_intdigest(raw[a:b], s) for a, b, s in spans], dtype=np.uint64)
                both = (h, g.view(np.int64), np.full(len(h), doc), np.full(len(h), th), pack)
                for out, x in zip(columns, both, strict=True):
                    out.append(x)
            if columns[0]:
                yield from made([np.concatenate(x) for x in columns])

    return batches


def _rows(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names.split())


def _settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions sorted by anchor, digest and place: those equal to an earlier one, and the different ones of an
    anchor that has several. An anchor that occurs once is dropped. Between batches only two rows are held: the
    first of the anchor, which waits until a second digest is seen, and the last."""
    first = last = None
    several = False
    for part in parts:
        columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(columns[0]):
            continue
        if last is not None:
            columns = [np.append(x, y) for x, y in zip(last, columns, strict=True)]
        new = np.any([x[1:] != x[:-1] for x in columns], axis=0)  # repeated rows are one document
        keep = np.concatenate([[True], new])
        columns = [x[keep] for x in columns]
        h, g = columns[:2]
        old = np.zeros(len(h), dtype=bool)
        old[0] = last is not None
        new_h = np.concatenate([[last is None], h[1:] != h[:-1]])
        new_g = new_h | np.concatenate([[False], g[1:] != g[:-1]])
        run = np.cumsum(new_h) - new_h[0]
        many = np.bincount(run, weights=new_g) > 1
        if last is not None:  # the first run goes on: its first digest was seen before
            many[0] = several or new_g[run == 0].any()
            if many[0] and not several:
                yield _rows([np.zeros(1, dtype=bool), *(np.array([x]) for x in (first[0], *first[2:]))], SETTLED)
        out = ~old & (~new_g | many[run])
        yield _rows([x[out] for x in (~new_g, h, *columns[2:])], SETTLED)
        at = int(np.searchsorted(run, run[-1]))
        if at or last is None:
            first = [x[at] for x in columns]
        last, several = [x[-1:] for x in columns], bool(many[-1])


def _cut_regions(window: int):
    """Regions of (text, list of them) rows with their bytes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made: list[list] = [[], [], [], [], []]
            for doc, th, raw, found in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                for r in found:
                    _, first, last = _unpack(np.int64(r["pack"]))
                    for out, x in zip(made, (r["h"], doc, th, r["pack"], raw[first : last + window]), strict=True):
                        out.append(x)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc", "th", "pack", "bytes"])

    return batches


def _construct(window: int, anchor: int, collection: int):
    """Byte ranges (doc, th, start, end) of repeated windows of regions that come sorted by anchor."""
    reach = window - anchor  # columns left of the anchor

    def ranges(h: np.ndarray, doc: np.ndarray, th: np.ndarray, pack: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        place, first, last = _unpack(pack)
        left, right = reach - (place - first), reach - (place - last) + window - 1
        sizes = np.array([len(t) for t in texts])
        symbols = np.zeros((len(texts), reach + window), dtype=np.uint8)
        row = np.repeat(np.arange(len(texts)), sizes)
        column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
        symbols[row, column] = np.frombuffer(b"".join(texts), np.uint8)
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        rank = np.empty(len(h), dtype=np.int64)
        rank[np.lexsort((pack, th, doc))] = np.arange(len(h))
        marks = repeated_windows(symbols, left, right, group, rank, window)
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        at = place[row] - reach
        return _rows([doc[row], th[row], at + start, at + end - 1 + window], "doc th start end")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for part in parts:
            numbers = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            texts = part.column(4).to_pylist()
            if held is not None:
                numbers = [np.concatenate(x) for x in zip(held[0], numbers, strict=True)]
                texts = held[1] + texts
            if not texts:
                continue
            cut = int(np.searchsorted(numbers[0], numbers[0][-1]))
            if cut < collection:
                held = [numbers, texts]
                continue
            held = [[x[cut:] for x in numbers], texts[cut:]]
            yield ranges(*(x[:cut] for x in numbers), texts[:cut])
        if held is not None and held[1]:
            yield ranges(*held[0], held[1])

    return batches


def _windows(window: int):
    """(w, v, doc, th, start) of every window of regions: two hashes of its bytes and where it begins."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            made: list[list] = [[], [], [], [], []]
            for _, doc, th, pack, raw in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                _, first, last = _unpack(np.int64(pack))
                for i in range(int(last - first) + 1):
                    d = xxhash.xxh128_digest(raw[i : i + window])
                    w, v = np.frombuffer(d, "<i8").tolist()
                    for out, x in zip(made, (w, v, doc, th, int(first) + i), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], "w v doc th start".split())

    return batches


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, raw): documents in their order, ids that are null last, and a hash that tells rows of one id apart."""
    return docs.select(*key_columns(id_col, text_col))


def key_columns(id_col: str, text_col: str) -> list[Column]:
    raw = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    return [doc.alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), raw.alias("raw")]


def repeated_ranges(
    rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, collection: int = COLLECTION
) -> DataFrame:
    """(doc, th, start, end): byte ranges that together cover what repeats in rows (doc, th, raw)."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    if window - anchor > 255 or anchor & (anchor - 1):
        raise ValueError("anchors are a power of two, and windows at most 255 bytes longer")
    make = lambda made: rows.mapInArrow(_region_batches(window, anchor, made), REGION)
    found = make(lambda columns: [_rows(columns, "h g doc th pack")])

    # Anchors that would make one task much longer than the others: those with more than ``hot`` regions in the parts
    # of the input where they are at least a thousandth. Which these are changes the way, not the result.
    def frequent(columns: list[np.ndarray]) -> list[pa.RecordBatch]:
        h, count = np.unique(columns[0], return_counts=True)
        some = count * 1000 >= len(columns[0])
        return [_rows([h[some], count[some]], "h n")] if some.any() else []

    counts = rows.mapInArrow(_region_batches(window, anchor, frequent), "h bigint, n bigint")
    skewed = stage(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > hot), "skewed-anchors")
    any_skewed = bool(skewed.take(1))
    main = found.join(skewed, "h", "left_anti") if any_skewed else found
    order = ["h", "g", "doc", "th", "pack"]
    sorted_ = main.select(*order).repartition(n, "h").sortWithinPartitions(*order)
    schema = "again boolean, h bigint, doc bigint, th bigint, pack bigint"
    settled = stage(sorted_.mapInArrow(_settle, schema), "regions")
    if any_skewed:
        # The same with firsts by pre-aggregation, and the others by a join whose hot keys can be split.
        some = stage(found.join(skewed.select("h"), "h").distinct(), "skewed-regions")
        where = F.struct("doc", "th", "pack")
        firsts = stage(some.groupBy("h", "g").agg(F.min(where).alias("first")), "skewed-firsts")
        again = some.join(firsts, ["h", "g"]).filter(where != F.col("first"))
        many = firsts.groupBy("h").count().filter("count > 1").select("h")
        settled = settled.unionAll(again.select(F.lit(True).alias("again"), "h", "doc", "th", "pack"))
        settled = settled.unionAll(firsts.join(many, "h").select(F.lit(False).alias("again"), "h", "first.*"))

    start, end = F.expr("(pack >> 16) - ((pack >> 8) & 255)"), F.expr(f"(pack >> 16) - (pack & 255) + {window}")
    ranges = lambda df: df.select("doc", "th", start.alias("start"), end.alias("end"))
    out = ranges(settled.filter("again"))
    edges = settled.filter("not again").select("h", "doc", "th", "pack")

    def with_bytes(some: DataFrame) -> DataFrame:
        lists = some.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "pack")).alias("found"))
        texts = rows.join(lists, ["doc", "th"]).select("doc", "th", "raw", "found").dropDuplicates(["doc", "th"])
        return texts.mapInArrow(_cut_regions(window), "h bigint, doc bigint, th bigint, pack bigint, bytes binary")

    large = stage(edges.groupBy("h").count().filter(F.col("count") > hot), "large-anchors")
    if large.take(1):
        # Too many different regions for one construction: their windows one by one, by digest.
        fields = "w bigint, v bigint, doc bigint, th bigint, start bigint"
        single = stage(with_bytes(edges.join(large, "h", "left_semi")).mapInArrow(_windows(window), fields), "windows")
        at = F.struct("doc", "th", "start")
        least = single.groupBy("w", "v").agg(F.min(at).alias("first"))
        later = single.join(least, ["w", "v"]).filter(at != F.col("first"))
        out = out.unionAll(later.select("doc", "th", "start", (F.col("start") + window).alias("end")))
        edges = edges.join(large, "h", "left_anti")
    texts = with_bytes(edges).repartition(n, "h").sortWithinPartitions("h", "doc", "th", "pack")
    built = texts.mapInArrow(_construct(window, anchor, collection), "doc bigint, th bigint, start bigint, end bigint")
    return out.unionAll(built)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot: int = HOT,
    collection: int = COLLECTION,
) -> DataFrame:
    """(doc_id, n_bytes, ranges, kept): the byte ranges of every text to remove, and the bytes that remain.

    Ranges [start, end) are joined where they touch; they cover each window of ``window`` bytes that begins earlier
    too: in a row with a smaller id, or further ahead in the text. Among rows of one id with different texts the one
    with the smaller text hash counts as earlier; rows that repeat altogether are one document, with the same result
    each. Null texts are empty; null ids come after all others. Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    pair = F.struct("start", "end")
    found = repeated_ranges(rows, window, anchor, hot, collection)
    found = found.groupBy("doc", "th").agg(F.collect_set(pair).alias("ranges"))
    # The id in its own type, and null where it was null.
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    both = source.select("doc_id", *key_columns("doc_id", "text")).join(found, ["doc", "th"], "left").select("doc_id", "raw", "ranges")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            sizes, spans, kept = [], [], []
            for raw, ranges in zip(part.column("raw").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                at, pieces = 0, []
                for a, b in joined:
                    pieces.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in joined])
                kept.append(b"".join([*pieces, raw[at:]]))
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "ranges", "kept"])

    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, ranges array<struct<start:bigint,end:bigint>>, kept binary"
    return both.mapInArrow(batches, schema)
