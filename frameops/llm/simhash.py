"""Near duplicates by SimHash: fingerprints, keys from the Golay code, links, components.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in 4 bits or
fewer, two of the three segments together differ in 2 or fewer, and each of those shares a Golay
key (see ``golay``). The pairs of keys of each pair of segments are the buckets; every bucket is
verified on whole fingerprints. Copies collapse to one fingerprint before that, and a bucket
emits links that keep its members connected, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text, per_text
from frameops.llm.components import connected_components
from frameops.llm.golay import codeword_keys
from frameops.session import shuffle_partitions, stage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
PAIRS = ((0, 1), (0, 2), (1, 2))
# A bucket with more members is verified in blocks of about this many, each pair of blocks a task's group.
BLOCK = 4096
# Buckets up to this size are verified many at a time; larger ones emit a tree of links.
SMALL = 16


def fingerprint(text: str, words_each: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed number; no words: zero."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[words_each:] or starts[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS):
    """(doc_id, fp): one row per row of ``docs``; null texts count as empty, fingerprint zero."""
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return per_text(
        rows, f"doc_id {kind}, fp bigint", ["doc_id"], lambda: lambda texts: [[fingerprint(t, words) for t in texts]]
    )


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bucket_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which word): all bucket keys of unsigned 64-bit words."""
    keys = [codeword_keys((words >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    out, of = [], []
    for which, (i, j) in enumerate(PAIRS):
        both = keys[i][:, :, None] << 12 | keys[j][:, None, :] | which << 24
        fits = (keys[i] >= 0)[:, :, None] & (keys[j] >= 0)[:, None, :]
        out.append(both[fits])
        of.append(np.broadcast_to(np.arange(len(words))[:, None, None], fits.shape)[fits])
    return np.concatenate(out), np.concatenate(of)


def links_of(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each component of words that differ in ``most`` bits or fewer."""
    left, links = np.unique(words), []
    while len(left) > 1:
        found, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for word in front:
                near |= np.bitwise_count(left ^ word) <= most
            front, left = left[near], left[~near]
            found.append(front)
        one = np.concatenate(found)
        links += [(x, one.min()) for x in one if x != one.min()]
    return links


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(words), 4096):
            keys, of = bucket_keys(words[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words[at : at + 4096][of].view(np.int64))], ["key", "fp"])


def _verify(most: int):
    """Links of rows (key, part, fp) that come sorted, so that a bucket's rows are neighbours."""

    def links(columns: list[np.ndarray]) -> list[tuple[int, int]]:
        key, part, fp = columns
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], new, [len(key)]])
        sizes = np.diff(starts)
        word, found = fp.view(np.uint64), []
        group = np.repeat(np.arange(len(sizes)), np.where(sizes <= SMALL, sizes, 0))
        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        for step in range(1, SMALL):
            at = np.flatnonzero(group[step:] == group[:-step])
            if not len(at):
                break
            a, b = small[at], small[at + step]
            near = np.bitwise_count(word[a] ^ word[b]) <= most
            found += zip(fp[a[near]].tolist(), fp[b[near]].tolist(), strict=True)
        for i in np.flatnonzero(sizes > SMALL):
            linked = links_of(word[starts[i] : starts[i + 1]], most)
            found += [(int(a.view(np.int64)), int(b.view(np.int64))) for a, b in linked]
        return found

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()
        for part in parts:
            columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            key, sub, _ = columns
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [x[cut:] for x in columns]
            if cut:
                made = set(links([x[:cut] for x in columns])) - seen
                seen = seen | made if len(seen) < 1 << 16 else made
                yield _link_batch(made)
        if held is not None and len(held[0]):
            yield _link_batch(set(links(held)) - seen)

    return batches


def _link_batch(links: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(links)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in rows], type=pa.int64()) for i in (0, 1)], names=["u", "v"]
    )


def fingerprint_links(distinct: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``distinct`` (fp) within ``most`` bits, 4 at the most."""
    if most > 4:
        raise ValueError("the keys cover 4 differing bits")
    keys = distinct.select("fp").mapInArrow(_keys, "key bigint, fp bigint")
    hot = stage(keys.groupBy("key").count().filter(F.col("count") > block), "hot-buckets")
    if hot.take(1):
        blocks = F.ceil(F.col("count") / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.expr(
            "transform(sequence(0, blocks - 1), j -> cast(least(own, j) as long) * blocks + greatest(own, j))"
        )
        split = keys.join(hot.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
        keys = (
            keys.join(hot, "key", "left_anti")
            .withColumn("part", F.lit(-1).cast("long"))
            .select("key", "part", "fp")
            .unionAll(split.select("key", F.explode(pairs).alias("part"), "fp"))
        )
    else:
        keys = keys.select("key", F.lit(-1).cast("long").alias("part"), "fp")
    sorted_keys = keys.repartition(shuffle_partitions(distinct.sparkSession), "key", "part").sortWithinPartitions(
        "key", "part", "fp"
    )
    return sorted_keys.mapInArrow(_verify(most), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    most: int = MAX_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``, repeated rows included.

    ``component_id`` is the smallest doc_id reachable over links of ``most`` differing bits or fewer.
    Null and empty texts have fingerprint zero and link like any other. Null ids take part; a component
    of null ids only has a null id. An empty table gives no rows. Other columns are not read.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    of = stage(fingerprint_components(rows, most, block), "fingerprint-components")
    return rows.join(of.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(rows: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id): per distinct fingerprint its component, and the smallest doc_id in it."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    nodes = connected_components(fingerprint_links(distinct, most, block), "fingerprint-links")
    rooted = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def keep_one_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    most: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with all its columns, one row of each component: that with the smallest id.

    Among repeated rows of that id and fingerprint the one with the smallest text stays. Which ids stay is
    settled on narrow rows; the whole rows are joined with that once.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    of = stage(fingerprint_components(rows, most), "fingerprint-components")
    taken = {c.lower() for c in docs.columns}
    id_, fp, n = (next(x for i in range(99) if (x := f"{name}_{i}") not in taken) for name in ("id", "fp", "n"))
    first = rows.join(of, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = first.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("one")).select("one.*")
    rows_of_id = rows.groupBy(F.col("doc_id").alias("other")).agg(F.count("*").alias(n))
    keep = one.join(rows_of_id, F.col("doc_id").eqNullSafe(F.col("other")))
    keep = stage(keep.select(F.col("doc_id").alias(id_), F.col("fp").alias(fp), n), "kept-ids")

    chosen = docs.join(keep, docs[f"`{id_col}`"].eqNullSafe(keep[id_]))
    single = chosen.filter(F.col(n) == 1).select(*docs.columns)
    repeated = chosen.filter(F.col(n) > 1)
    if not keep.filter(F.col(n) > 1).take(1):
        return single

    def same(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, wanted = part.column(text_col).to_pylist(), part.column(fp).to_pylist()
            yield part.filter(pa.array([fingerprint(t or "", words) == w for t, w in zip(texts, wanted, strict=True)]))

    repeated = repeated.mapInArrow(same, repeated.schema)
    place = Window.partitionBy(id_, fp).orderBy(F.col(f"`{text_col}`").asc_nulls_first())
    repeated = repeated.withColumn(n, F.row_number().over(place)).filter(F.col(n) == 1)
    return single.unionAll(repeated.select(*docs.columns))
