"""Nearest neighbours by largest inner product, over shifted Hilbert orderings of projected vectors.

Several curves each order all vectors by a few random directions of their own; on every curve a query meets
the vectors in a window around its place, and of those the ones it has not met in the window of an earlier curve.
The windows' best are merged and ranked on the original vectors. How wide the windows are, as a share of all
vectors, is settled on a bounded sample against brute force, and is the same at every size. Equal vectors travel
as one, with the ids that a result can have.

Curves are put in order with ids alone. Vectors then go to the blocks of the curves, with their places on all
curves, which decide what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm.hilbert import hilbert_index
from frameops.session import shuffle_partitions, stage

BITS = 7


@dataclass(frozen=True)
class Settings:
    curves: int = 16
    dimensions: int = 6  # directions per curve
    recall: float = 0.935  # on the sample
    sample: int = 4_096  # distinct vectors used for the fit, at most
    block: int = 4_096  # vectors of a curve that a task holds at a time, at most
    seed: int = 7
    # Widths that are tried; after them, all vectors.
    shares: tuple[float, ...] = tuple(round(0.002 * 1.05**i, 5) for i in range(128))


class Curves:
    """Curve positions of vectors. Inner products become angles by one more coordinate that evens out the lengths;
    queries, whose length does not matter, have zero there."""

    def __init__(self, sample: np.ndarray, longest: float, settings: Settings) -> None:
        random = np.random.default_rng(settings.seed)
        size = sample.shape[1] + 1
        self.longest, self.count, of = longest, settings.curves, settings.dimensions
        rows = []
        while len(rows) < self.count * of:  # fresh orthogonal directions until there are enough
            rows += list(np.linalg.qr(random.normal(size=(size, size)))[0])
        self.directions = np.array(rows[: self.count * of])
        seen = self.extended(sample, False) @ self.directions.T
        self.low, high = seen.min(0), seen.max(0)
        span = np.maximum(high - self.low, 1e-12)
        # Each curve's grid is twice as wide as the sample and shifted by its own amount.
        self.shift = random.random(self.count * of)
        self.scale = (1 << BITS) / (2 * span)

    def extended(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1)
        if query:  # scaled to the same length as the others
            scaled = vectors * (self.longest / np.maximum(norms, 1e-300))[:, None]
            return np.hstack([scaled, np.zeros((len(vectors), 1))])
        return np.hstack([vectors, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))[:, None]])

    def positions(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """A column of curve positions for each curve."""
        grid = (self.extended(vectors, query) @ self.directions.T - self.low) * self.scale
        grid = np.clip(grid + self.shift * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_index(x, BITS) for x in np.split(grid, self.count, axis=1)], axis=1)


def fit_share(sample: np.ndarray, total: int, curves: Curves, k: int, settings: Settings) -> float:
    """The smallest window share that finds the asked part of the true neighbours within the sample.

    The ``k`` nearest of all vectors are, of a sample, as many fewer as the sample is smaller.
    """
    n = len(sample)
    k = max(1, int(np.ceil(k * n / total)))
    some = np.linspace(0, n - 1, min(n, 512)).astype(int)
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
    own = curves.positions(sample, False)
    asked = curves.positions(sample[some], True)
    away = np.full((len(some), n), np.inf)
    for c in range(curves.count):
        order = np.argsort(own[:, c], kind="stable")
        place = np.empty(n)
        place[order] = np.arange(n)
        at = np.searchsorted(own[order, c], asked[:, c])
        away = np.minimum(away, np.abs(place[None, :] - at[:, None]))
    near = np.take_along_axis(away, best, axis=1) / n
    return next((s for s in settings.shares if (near <= s).mean() >= settings.recall), 1.0)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector, as doubles, that is neither null nor zero and has only finite components."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    is_query=lambda vec_id: vec_id % 20 == 0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    settings: Settings = Settings(),
    compared: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows found, nearest first, ties to the smaller id.

    The score is the inner product in double precision on the original vectors. Null, zero and non-finite vectors
    and null ids take no part; of the others, two lengths are an error. Rows that repeat count once. With ``k`` or
    fewer other rows all are returned, with none no row. ``compared`` adds up the pairs whose score was computed.
    """
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "v"])
    rows = stage(rows, "vectors")
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    if sizes["least"] is None:
        return spark.createDataFrame([], out)
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components")

    # Of equal vectors, k + 1 ids are enough for every result; the first stands for the group.
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    groups = stage(ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "groups")
    groups = groups.withColumn("gid", F.col("ids")[0])
    asked = rows.filter(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id")
    asked = stage(asked.join(groups, "v").select("query_id", "gid"), "queries")
    queries = stage(groups.join(asked.select("gid").distinct(), "gid").select("gid", "v"), "query-vectors")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = groups.agg(F.max(norm).alias("longest"), F.count("*").alias("n")).first()
    seen = groups.orderBy(F.xxhash64("gid"), "gid").limit(settings.sample).select("v").collect()
    sample = np.array([r["v"] for r in seen])
    curves = Curves(sample, facts["longest"], settings)
    share = fit_share(sample, facts["n"], curves, k, settings)
    # Vectors of single precision are moved as such; scores are computed in double precision all the same.
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    if kind == "float":
        groups = groups.withColumn("v", F.col("v").cast("array<float>"))
        queries = queries.withColumn("v", F.col("v").cast("array<float>"))

    # As wide as all vectors if few: a query meets at least k others that way.
    width = max(int(np.ceil(share * facts["n"])), k)
    found = _windows(groups.select("gid", "v"), queries, curves, width, k, settings, compared)
    found = found.groupBy("gid", "near").agg(F.max("score").alias("score"))
    top = Window.partitionBy("gid").orderBy(F.desc("score"), "near")
    found = found.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1)
    hits = found.join(groups.select(F.col("gid").alias("near"), "ids"), "near")
    hits = hits.select("gid", F.explode("ids").alias("vec_id"), "score")
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("score"), "vec_id")))
    best = F.struct((-F.col("score")).alias("away"), "vec_id", "score")
    hits = hits.filter(F.col("nth") <= k + 1).groupBy("gid").agg(F.array_sort(F.collect_list(best)).alias("hits"))
    each = asked.join(hits, "gid").select(
        "query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits")
    )
    each = each.select("query_id", F.posexplode("hits").alias("nth", "hit"))
    return each.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, none of them null and all of one length, a row each."""
    flat = part.column(part.schema.names.index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(part.num_rows, -1)


def _places(all_: DataFrame, queries: DataFrame, curves: Curves) -> DataFrame:
    """(gid, query, places): for each vector, and each query, how many vectors are before it on every curve."""
    spark = all_.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def place(query: bool):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    at = shared.value.positions(_vectors(part), query)
                    curve = np.repeat(np.arange(at.shape[1], dtype=np.int32), len(at))
                    gid = np.tile(part.column("gid").to_numpy(zero_copy_only=False), at.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(curve), pa.array(at.T.ravel()), pa.array(np.full(len(gid), int(query), np.int32)), pa.array(gid)],
                        ["curve", "at", "query", "gid"],
                    )

        return batches

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors of its curve are before each row in this slice."""
        from pyspark import TaskContext

        task, so_far = TaskContext.get().partitionId(), {}
        for part in parts:
            curve, query = (part.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "query"))
            nth = np.zeros(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                rows = np.flatnonzero(curve == c)
                vectors = 1 - query[rows]
                nth[rows] = so_far.get(c, 0) + np.cumsum(vectors) - vectors
                so_far[c] = so_far.get(c, 0) + int(vectors.sum())
            made = [pa.array(np.full(len(curve), task, dtype=np.int64)), pa.array(nth)]
            columns = [part.column(c) for c in ("curve", "query", "gid")]
            yield pa.RecordBatch.from_arrays([*columns, *made], ["curve", "query", "gid", "task", "nth"])

    schema = "curve int, at bigint, query int, gid bigint"
    # Vectors and queries are put in order together, so a query's place is its rank among the vectors.
    both = all_.mapInArrow(place(False), schema).unionAll(queries.mapInArrow(place(True), schema))
    order = ["curve", "at", "query", "gid"]
    both = both.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    both = stage(both.mapInArrow(number, "curve int, query int, gid bigint, task bigint, nth bigint"), "curves")
    counts = both.groupBy("curve", "task").agg(F.sum(1 - F.col("query")).alias("n"))
    before = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("curve", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = both.join(counts, ["curve", "task"])
    each = F.array_sort(F.collect_list(F.struct("curve", (F.col("ahead") + F.col("nth")).alias("place"))))
    return placed.groupBy("gid", "query").agg(F.transform(each, lambda x: x["place"]).alias("places"))


def _windows(
    all_: DataFrame, queries: DataFrame, curves: Curves, width: int, k: int, s: Settings, compared: Accumulator | None
) -> DataFrame:
    """(gid, near, score): the best of every block of every curve among the vectors in a query's window there that are
    in none of its windows on earlier curves."""
    n = shuffle_partitions(all_.sparkSession)
    placed = _places(all_, queries, curves)
    rows = placed.filter("query = 0").join(all_, "gid").select("gid", "v", "places")
    asked = placed.filter("query = 1").join(queries, "gid").select("gid", "v", "places")
    length = min(s.block, max(width, 256))
    one = [F.floor(F.col("place") / length)]
    first, last = F.floor(F.greatest(F.col("place") - width, F.lit(0)) / length), F.floor((F.col("place") + width) / length)
    of = lambda df, blocks: df.select(F.posexplode("places").alias("curve", "place"), "gid", "v", "places").select(
        "curve", F.explode(blocks).alias("block"), "gid", "v", "places"
    )
    met = of(rows, F.array(*one)).withColumn("query", F.lit(0)).unionAll(
        of(asked, F.sequence(first, last)).withColumn("query", F.lit(1))
    )
    met = met.repartition(n, "curve", "block").sortWithinPartitions("curve", "block", "query", "gid")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for part in parts:
            curve, block, query, gid = (part.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "block", "query", "gid"))
            vectors = _vectors(part)
            places = part.column("places").flatten().to_numpy(zero_copy_only=False).reshape(len(gid), -1)
            new = (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])
            cuts = np.flatnonzero(new) + 1
            for a, b in zip([0, *cuts], [*cuts, len(curve)], strict=True):
                if a == b:
                    continue
                if (curve[a], block[a]) != of:
                    of, held = (curve[a], block[a]), []
                some = (gid[a:b], vectors[a:b], places[a:b])
                if query[a] == 0:
                    held.append(some)
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    yield best(int(curve[a]), held[0], some)

    def best(curve: int, rows: tuple, asked: tuple) -> pa.RecordBatch:
        gid, vectors, places = rows
        found = []
        for query, q, at in zip(*asked, strict=True):
            some = np.flatnonzero(np.abs(places[:, curve] - at[curve]) <= width)
            for c in range(curve):  # met on an earlier curve
                some = some[np.abs(places[some, c] - at[c]) > width]
            if not len(some):
                continue
            if compared is not None:
                compared.add(len(some))
            near = vectors[some]
            if len(some) > k + 1:
                top = np.argpartition(-(near @ q), k)[: k + 1]
                some, near = some[top], near[top]
            # Sums in a fixed order: equal pairs of vectors have equal scores wherever they meet.
            found.append((np.full(len(some), query), gid[some], (near * q).sum(1)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(columns, types, strict=True)], ["gid", "near", "score"]
        )

    return met.mapInArrow(compare, "gid bigint, near bigint, score double")
