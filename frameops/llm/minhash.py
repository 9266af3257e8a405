"""Near-duplicates by MinHash: a multi-index join of b-bit signatures, confirmed on the full shingle sets.

A document's signature has ``symbols`` values of eight bits, each taken from the least of its shingles under one hash.
Two signatures that differ in ``most`` values or fewer have, by the pigeonhole principle, one of their chunks in which
``errors`` values differ at the most; so each chunk is a key once for every choice of that many values left out, and
such signatures share a key. ``most`` is chosen so that sets as similar as asked differ in more values with a chance
below one in a million.

Equal sets are one from the start. Then links that join whole groups are looked for first: in every bucket the first
set in some random order is the pivot, and every other set is compared with the pivots it has met. After that every
pair of sets of different groups that share a bucket is compared, so no link is lost; pairs inside a group need
no comparison. Signatures decide which pairs are worth it, shingle sets whether they are links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text
from frameops.llm.components import connected_components
from frameops.session import shuffle_partitions, stage

# Sets whose keys are put in order together before any is shuffled.
SETS_AT_ONCE = 16_384
# Rows of a bucket that one task compares.
BLOCK = 4_096


@dataclass(frozen=True)
class Settings:
    words: int = 3  # per shingle
    similar: tuple[int, int] = (85, 100)  # intersection : union, at least
    symbols: int = 65
    chunk: int = 5  # symbols per chunk
    most: int = 25  # differing symbols of a candidate pair

    @property
    def errors(self) -> int:
        return self.most // (self.symbols // self.chunk)

    @property
    def kept(self) -> list[tuple[int, ...]]:
        """The symbols that make each key."""
        starts = range(0, self.symbols - self.chunk + 1, self.chunk)
        return [tuple(a + i for i in c) for a in starts for c in combinations(range(self.chunk), self.chunk - self.errors)]

    def __post_init__(self) -> None:
        if self.symbols % self.chunk or self.errors >= self.chunk or self.chunk - self.errors > 6:
            raise ValueError("chunks must divide the symbols, and a key have one to six of them")


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit depending on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(texts: list[str], words: int) -> list[np.ndarray]:
    """64-bit hashes of the shingles of each text, repeats included, A-Z in lower case; of a shorter text its one."""
    split = [text.encode().lower().split() for text in texts]
    flat = [w for some in split for w in some]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.empty(0, np.uint64)
    odd = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    found, at = [], 0
    for some in split:
        h, at = hashes[at : at + len(some)], at + len(some)
        n = min(words, len(h))
        if n == 0:
            found.append(np.empty(0, np.uint64))
            continue
        rows = len(h) - n + 1
        sums = np.full(rows, n, dtype=np.uint64)
        for i in range(n):
            sums += h[i : i + rows] * odd[i]
        found.append(mixed(sums))
    return found


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes([text], words)[0])


def multipliers(symbols: int) -> np.ndarray:
    return mixed(np.arange(1_000, 1_000 + symbols, dtype=np.uint64)) | np.uint64(1)


def signatures(shingles: list[np.ndarray], symbols: int) -> np.ndarray:
    """A row of symbols for every set, none of them empty."""
    flat, starts = np.concatenate(shingles), np.cumsum([0, *map(len, shingles[:-1])])
    least = [np.minimum.reduceat(flat * m, starts) for m in multipliers(symbols)]
    return (mixed(np.stack(least, axis=1)) >> np.uint64(56)).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    """Whether two sets, sorted, are as similar as asked."""
    small, large = sorted((len(a), len(b)))
    if s.similar[1] * small < s.similar[0] * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return s.similar[1] * both >= s.similar[0] * (small + large - both)


def signed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(doc_id, mark, n, digest, sig) of every row: a hash of its text, size and digest of its shingle set, and the
    signature, null if empty."""
    rows = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            at = 0
            while at < len(texts):  # some 100,000 words at a time
                first, size = at, 0
                while at < len(texts) and size < 600_000:
                    size, at = size + len(texts[at]), at + 1
                hashes = shingle_hashes(texts[first:at], s.words)
                some = [i for i, h in enumerate(hashes) if len(h)]
                sigs = signatures([hashes[i] for i in some], s.symbols) if some else None
                sig = dict(zip(some, (sigs if some else []), strict=True))
                sets = [np.unique(h) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(first, at - first),
                        part.column("mark").slice(first, at - first),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([digest(x) for x in sets], pa.binary()),
                        pa.array([sig[i].tobytes() if i in sig else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "mark", "n", "digest", "sig"],
                )

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, mark bigint, n bigint, digest binary, sig binary"
    return rows.mapInArrow(batches, schema)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sig_array(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, symbols)


def bucket_keys(sigs: np.ndarray, s: Settings) -> np.ndarray:
    """A row of keys for every signature: the symbols kept, and which those are."""
    columns = []
    for nth, kept in enumerate(s.kept):
        key = np.full(len(sigs), nth, dtype=np.int64)
        for i in kept:
            key = (key << 8) | sigs[:, i]
        columns.append(key)
    return np.stack(columns, axis=1)


def buckets(sets: DataFrame, s: Settings, at_once: int = SETS_AT_ONCE) -> DataFrame:
    """(key, sid) of all buckets with two sets or more.

    Tasks put the keys of many sets in order first. Of sets that share a key there, one is sent on for all; so a key
    that a third of all sets have is one row per batch in the shuffle, and the others are known to share it.
    """

    def work(others: bool):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for part in parts:
                held.append((part.column("sid").to_numpy(zero_copy_only=False), sig_array(part.column("sig"), s.symbols)))
                n += part.num_rows
                if n >= at_once:
                    yield group(held)
                    held, n = [], 0
            if n:
                yield group(held)

        def group(held: list) -> pa.RecordBatch:
            sid, sigs = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = bucket_keys(sigs, s)
            sid, keys = np.repeat(sid, keys.shape[1]), keys.ravel()
            order = np.lexsort((sid, keys))
            sid, keys = sid[order], keys[order]
            first = np.append(True, keys[1:] != keys[:-1])
            several = np.append(~first[1:], False)  # of the first of a key: another follows
            some = ~first if others else first
            columns = [pa.array(keys[some]), pa.array(sid[some]), pa.array(several[some])]
            return pa.RecordBatch.from_arrays(columns, ["key", "sid", "several"])

        return batches

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            # The last row waits for what follows; a bucket that a batch was cut in has been sent on in part.
            made, held = keep([x[:-1] for x in columns], columns[0][-1]), [x[-1:] for x in columns]
            if len(made[0]) and made[0][-1] == held[0][0]:
                held[2] = np.array([True])
            yield batch(made)
        if held is not None:
            yield batch(keep(held, None))

    def keep(columns: list[np.ndarray], after: int | None) -> list[np.ndarray]:
        key, sid, several = columns
        before = np.append(False, key[1:] == key[:-1]) if len(key) else np.empty(0, dtype=bool)
        follows = np.append(key[1:] == key[:-1], len(key) > 0 and after is not None and key[-1] == after)[: len(key)]
        some = several.astype(bool) | before | follows
        return [key[some], sid[some]]

    def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "sid"])

    rows, schema = sets.select("sid", "sig"), "key bigint, sid bigint, several boolean"
    sent = rows.mapInArrow(work(False), schema)
    sent = sent.repartition(shuffle_partitions(sets.sparkSession), "key").sortWithinPartitions("key", "sid")
    others = rows.mapInArrow(work(True), schema).select("key", "sid")
    return sent.mapInArrow(shared, "key bigint, sid bigint").unionAll(others)


def pivot_pairs(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(u, v): every set with the pivots of its buckets that are near enough. In one order of all sets v is before u."""
    order = F.struct(F.xxhash64("sid"), "sid")
    pivots = stage(members.groupBy("key").agg(F.min(order).alias("pivot")).select("key", F.col("pivot.sid").alias("v")), "pivots")
    pairs = members.join(pivots, "key").filter("sid <> v").select(F.col("sid").alias("u"), "v").distinct()
    facts = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    pairs = pairs.join(facts("u"), "u").join(facts("v"), "v").filter(_sizes_fit("n_u", "n_v", s))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = (sig_array(part.column(c), s.symbols) for c in ("sig_u", "sig_v"))
            some = pa.array((a != b).sum(axis=1) <= s.most)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(some) for c in ("u", "v")], ["u", "v"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(batches, "u bigint, v bigint")


def first_of(pairs: DataFrame) -> DataFrame:
    """(u, v): of the pivots of each set the first in the order of all sets."""
    first = pairs.groupBy("u").agg(F.min(F.struct(F.xxhash64("v"), "v")).alias("first"))
    return first.select("u", "first.v")


def _sizes_fit(a: str, b: str, s: Settings) -> Column:
    return s.similar[1] * F.least(a, b) >= s.similar[0] * F.greatest(a, b)


ROW = "key bigint, part bigint, own int, sid bigint, label bigint, n bigint, sig binary"


def open_buckets(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The sets of buckets with several groups, as ``ROW``.

    A bucket of more than ``block`` sets is cut into blocks, and each pair of those is compared by itself.
    """
    sizes = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    parts = F.ceil(F.col("size") / block).cast("int")
    mixed_keys = stage(sizes.filter("low < high").select("key", parts.alias("parts")), "open-buckets")
    rows = members.join(mixed_keys, "key").join(sets.select("sid", "n", "sig"), "sid")
    own = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    pairs = F.expr("transform(sequence(0, parts - 1), j -> cast(least(own, j) as bigint) * parts + greatest(own, j))")
    rows = rows.withColumn("own", own).withColumn("part", F.explode(pairs))
    return rows.select("key", "part", "own", "sid", "label", "n", "sig")


def per_bucket(rows: DataFrame, work: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the rows of every bucket, or pair of blocks."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = None
        for some in parts:
            key, part = (some.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if (key[a], part[a]) != of:
                    if held:
                        yield work(held)
                    held, of = [], (key[a], part[a])
                held.append(some.slice(a, b - a))
        if held:
            yield work(held)

    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "part")
    return rows.sortWithinPartitions("key", "part", "own", "sid").mapInArrow(batches, schema)


def near_pairs(held: list[pa.RecordBatch], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of sets of different groups that are near enough, in the rows of one bucket, the nearest of
    some thousand first. A pair is met once in all buckets: by the first of its shared keys."""
    kept = s.kept
    key, _, own, _, label, n = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(6))
    sigs = np.concatenate([sig_array(x.column(6), s.symbols) for x in held])
    two = own[0] != own[-1]  # a pair of blocks: rows of one against those of the other
    left = np.flatnonzero(own == own[0]) if two else np.arange(len(own))
    right = np.flatnonzero(own != own[0]) if two else left
    mine = int(key[0]) >> (8 * len(kept[0]))
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        low, high = np.minimum(n[some][:, None], n[right]), np.maximum(n[some][:, None], n[right])
        fit = (label[some][:, None] != label[right]) & (s.similar[1] * low >= s.similar[0] * high)
        if not two:
            fit &= some[:, None] < right
        i, j = np.nonzero(fit)
        for cut in range(0, len(i), 1 << 18):
            a, b = some[i[cut : cut + (1 << 18)]], right[j[cut : cut + (1 << 18)]]
            off = sigs[a] != sigs[b]
            away = off.sum(axis=1)
            near = np.flatnonzero(away <= s.most)
            for earlier in kept[:mine]:
                near = near[off[np.ix_(near, earlier)].any(axis=1)]
            near = near[np.argsort(away[near], kind="stable")]
            if len(near):
                yield a[near], b[near]


def sets_in_question(rows: DataFrame, s: Settings) -> DataFrame:
    """The rows of sets that have a near pair in their bucket: at most those there are, however many pairs."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = np.zeros(sum(x.num_rows for x in held), dtype=bool)
        for a, b in near_pairs(held, s):
            some[a] = some[b] = True
        whole = pa.Table.from_batches(held).filter(pa.array(some)).combine_chunks().to_batches()
        return whole[0] if whole else held[0].slice(0, 0)

    return per_bucket(rows, work, ROW)


def bucket_links(rows: DataFrame, s: Settings) -> DataFrame:
    """(u, v): links between groups, from rows with their ``text``. Of a bucket's groups that are linked, enough links
    to join them; pairs of groups that are joined already are not looked at."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sid, label = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (3, 4))
        texts = [t for x in held for t in x.column(7).to_pylist()]
        sets: list = [None] * len(texts)
        of = dict.fromkeys(label.tolist())
        root = {x: x for x in of}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def set_of(i: int) -> np.ndarray:
            if sets[i] is None:
                sets[i] = shingle_set(texts[i], s.words)
            return sets[i]

        found = []
        for some in near_pairs(held, s):
            for i, j in zip(*(x.tolist() for x in some), strict=True):
                a, b = find(int(label[i])), find(int(label[j]))
                if a != b and similar(set_of(i), set_of(j), s):
                    root[a] = b
                    found.append((int(sid[i]), int(sid[j])))
        return pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], ["u", "v"])

    return per_bucket(rows, work, "u bigint, v bigint")


class Texts:
    """Texts of sets, one for each, fetched once and only of sets that are in some candidate pair."""

    def __init__(self, docs: DataFrame, sets: DataFrame, s: Settings) -> None:
        self.docs, self.sets, self.s, self.known = docs, sets, s, None

    def of(self, sids: DataFrame) -> DataFrame:
        """(sid, text) of these sets, and of others."""
        if self.known is not None:
            sids = sids.join(self.known.select("sid"), "sid", "left_anti")
        wanted = stage(self.sets.join(sids, "sid").select("sid", "least", "mark", "digest"), "wanted")
        if self.known is not None and not wanted.take(1):
            return self.known
        # An id may have several texts, and texts may have no id.
        same = F.col("doc_id").eqNullSafe(F.col("least")) & (F.xxhash64("text") == F.col("mark"))
        words, rows = self.s.words, self.docs.join(wanted, same)

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                made = [digest(shingle_set(t, words)) for t in part.column("text").to_pylist()]
                own = pa.array([a == b for a, b in zip(made, part.column("digest").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(own) for c in ("sid", "text")], ["sid", "text"])

        found = rows.select("sid", "text", "digest").mapInArrow(batches, "sid bigint, text string")
        found = stage(found.groupBy("sid").agg(F.first("text").alias("text")), "texts")
        self.known = found if self.known is None else self.known.unionAll(found)
        return self.known


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (u, v) that are links by their full sets."""
    text = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for part in parts:
            keep = []
            for v, a, b in zip(*(part.column(c).to_pylist() for c in ("v", "text_u", "text_v")), strict=True):
                if v != held[0]:  # a pivot has many pairs, one after the other
                    held = (v, shingle_set(b, s.words))
                keep.append(similar(shingle_set(a, s.words), held[1], s))
            some = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(some) for c in ("u", "v")], ["u", "v"])

    joined = pairs.join(text("u"), "u").join(text("v"), "v")
    return stage(joined.select("u", "v", "text_u", "text_v").mapInArrow(batches, "u bigint, v bigint"), "links")


def ancestors(parents: DataFrame, jumps: int = 2) -> DataFrame:
    """(sid, label): what each set's chain of parents (u, v) leads to, ``2 ** jumps`` steps away or at its end."""
    labels = parents.toDF("sid", "label")
    for _ in range(jumps):
        up = labels.toDF("label", "up")
        labels = labels.join(up, "label", "left").select("sid", F.coalesce("up", "label").alias("label"))
    return stage(labels, "labels")


def set_groups(docs: DataFrame, sets: DataFrame, s: Settings, block: int = BLOCK) -> DataFrame:
    """(sid, label): for every set that is linked with another the group it is in."""
    members = stage(buckets(sets, s), "buckets")
    near = stage(pivot_pairs(members, sets, s), "near-pivots")
    texts = Texts(docs, sets, s)
    links = confirmed(near, texts.of(near.select(F.explode(F.array("u", "v")).alias("sid")).distinct()), s)
    # A pivot is before its bucket in one order of all sets, so one pivot for each set makes trees.
    labels = ancestors(first_of(links))
    known = members.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    rows = stage(sets_in_question(open_buckets(stage(known, "labelled"), sets, block), s), "in-question")
    links = bucket_links(rows.join(texts.of(rows.select("sid").distinct()), "sid").select(*rows.columns, "text"), s)
    links = stage(links.distinct(), "links")
    if not links.take(1):
        return labels
    for c in ("u", "v"):
        links = links.join(labels.toDF(c, f"of_{c}"), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
    to = stage(connected_components(links.select("u", "v"), "groups").toDF("label", "to"), "groups")
    moved = labels.join(to, "label", "left").select("sid", F.coalesce("to", "label").alias("label"))
    # Sets that had no link to a pivot are labels of their own.
    alone = to.select(F.col("label").alias("sid"), F.col("to").alias("label")).join(labels.select("sid"), "sid", "left_anti")
    return stage(moved.unionAll(alone), "groups")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``, repeated rows included.

    ``n_shingles`` is the number of distinct shingles; documents whose sets are as similar as asked are linked, and
    ``component_id`` is the smallest doc_id reachable; ``kept`` says that it is the row's own. Documents without words,
    null texts among them, are linked with nothing. Null ids take part and are never smallest; a component of null
    ids only has a null id and its rows are kept. Other columns are not read; an empty table gives no rows. Shingles
    are told apart by 64-bit hashes, sets by 128-bit digests of those.
    """
    rows = stage(signed(docs, id_col, text_col, settings), "signatures")
    # The row that stands for a set: that with the smallest id.
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("least"), "mark"))
    sets = rows.filter("n > 0").groupBy("digest").agg(first.alias("first"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    sets = sets.select("digest", "first.least", "first.mark", "n", "sig", F.monotonically_increasing_id().alias("sid"))
    sets = stage(sets, "sets")
    labels = set_groups(id_and_text(docs, id_col, text_col), sets, settings, block)
    of = sets.join(labels, "sid", "left").select("digest", "least", F.coalesce("label", "sid").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stage(of.join(least, "label").select("digest", "component_id"), "components")
    found = rows.join(of, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
