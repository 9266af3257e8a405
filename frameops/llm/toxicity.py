"""Toxicity: texts are restored (see ``deobfuscate``) and the restored words are scored.

Three steps, each a Spark job over texts: letter trigrams of all documents; words and beginnings of words
that labelled rows of the two classes differ in; a logistic model on those. The labelled rows used are at
most ``Fit.rows``, those with the smallest hash of the id; everything else covers every document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm.common import id_and_text
from frameops.llm.deobfuscate import (
    NOISE,
    OUTER,
    SIGNS,
    SIZE,
    WORD,
    Channel,
    LetterModel,
    Restorer,
    parts_of,
    text_trigrams,
)
from frameops.session import stage

THRESHOLD = 0.7
LONGEST_KEPT, MOST_KEPT = 64, 400_000  # characters of a run of signs that is remembered, and such runs in a task
PREFIXES = (3, 4, 5, 6)
LENGTHS = range(1, PREFIXES[-1] + 1)  # of a beginning with every letter once


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit."""

    rows: int = 20_000  # labelled rows at most
    features: int = 2_048  # words and beginnings the model knows, at most
    least_rows: int = 3  # labelled rows that a feature is in, at least
    steps: int = 400
    decays: tuple[float, ...] = (0.1, 0.03, 0.01, 0.003)  # tried on halves of the rows learned from


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 3, is 1. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def letter_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts of ``texts.text``, over all rows. At most ``SIZE ** 3`` counts come back, whatever the input."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, dtype=np.int64)
        for part in parts:
            counts += text_trigrams(part.column(0).to_pylist())
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["gram", "n"])

    sums = texts.select("text").mapInArrow(batches, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3, dtype=np.int64)
    for row in sums.collect():
        counts[row["gram"]] = row["n"]
    return counts


def once(word: str) -> str:
    """A word with every letter that is repeated once."""
    return "".join([a for a, b in zip(word, word[1:] + " ", strict=False) if a != b])


def features_of(word: str) -> list[str]:
    """A word, and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def features_in(restorer: Restorer, text: str) -> set[str]:
    """The features of a text's restored words."""
    groups, tokens = restorer.split(text)
    words = {word for group in groups for word in group}
    words.update(*map(restorer.token, set(tokens)))
    starts = ({word[:k] for word in words if k < len(word)} for k in PREFIXES)
    return words.union(*({start + "*" for start in same} for same in starts))


@dataclass
class Model:
    letters: LetterModel
    channel: Channel
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to its score, for one task."""
        restorer, weights = Restorer(self.letters, self.channel), self.weights
        whole, stems = {f for f in weights if f[-1:] != "*"}, {f[:-1] for f in weights if f[-1:] == "*"}
        # How words with a feature begin: five letters, or all of a shorter beginning.
        starts, short = {f[:5] for f in whole | stems}, {f for f in stems if len(f) < 5}
        # The same with every letter once.
        bare, bare_whole, bare_stems = {once(f[:3]) for f in whole | stems}, set(map(once, whole)), set(map(once, stems))
        # Runs of signs seen before: those without a feature, as nearly all are, and the features of the others.
        plain: set[str] = set()
        marked: dict[str, list[str]] = {}

        def useful(words: Iterable[str]) -> list[str]:
            found = []
            for word in words:
                if word[:5] in starts or word[:4] in short or word[:3] in short:
                    found += [f for f in features_of(word) if f in weights]
            return found

        def may_be(token: str) -> bool:
            """Whether a run whose only noise are repeated letters, which restoring takes out, can have a feature."""
            parts = parts_of(token)
            words = [once(part) for part in parts]
            if not any(word[:3] in bare or word[:2] in bare or word[:1] in bare for word in words):
                return False
            if not all(map(WORD.fullmatch, parts)):
                return True
            return any(w in bare_whole or not bare_stems.isdisjoint([w[:n] for n in LENGTHS]) for w in words)

        def features(token: str) -> list[str]:
            if not NOISE.search(token):
                core = token.strip(OUTER)
                return useful([core] if core.isascii() and core.isalpha() else WORD.findall(core))
            return useful(restorer.decoded(token)) if SIGNS.search(token) or may_be(token) else []

        def score(text: str) -> float:
            groups, tokens = restorer.split(text)
            found = {f for group in groups for f in useful(group)}
            for token in set(tokens) - plain:
                some = marked.get(token)
                if some is None:
                    some = features(token)
                    if len(token) <= LONGEST_KEPT:
                        if len(plain) + len(marked) >= MOST_KEPT:
                            plain.clear()
                            marked.clear()
                        if some:
                            marked[token] = some
                        else:
                            plain.add(token)
                found.update(some)
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[f] for f in sorted(found)), -50, 50))))

        return score


def fit_logistic(
    rows: list[list[int]], labels: np.ndarray, size: int, fit: Fit, decay: float
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on sets of features, by gradient steps with momentum and scaling."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([f for r in rows for f in r], dtype=np.int64)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(size + 1)
    w[size] = np.log(share / (1 - share))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, fit.steps + 1):
        z = w[size] + np.bincount(of, w[at], minlength=len(rows))
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        gradient = np.append(np.bincount(at, off[of], minlength=size), off.sum())
        gradient[:size] += decay / size * w[:size]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:size], float(w[size])


def choose_decay(rows: list[list[int]], labels: np.ndarray, size: int, fit: Fit) -> float:
    """The decay that decides most rows left out of the fit rightly at the threshold, every second row and then the
    others; of those the one with the least loss. Held-out rows play no part."""
    if len(fit.decays) == 1:
        return fit.decays[0]
    found, least = [], np.log(THRESHOLD / (1 - THRESHOLD))
    for decay in fit.decays:
        wrong, loss = 0, 0.0
        for left_out in (0, 1):
            mine = [i for i in range(len(rows)) if i % 2 != left_out]
            w, bias = fit_logistic([rows[i] for i in mine], labels[mine], size, fit, decay)
            for i in range(left_out, len(rows), 2):
                z = bias + sum(w[f] for f in rows[i])
                wrong += (z >= least) != labels[i]
                loss += np.logaddexp(0, -z if labels[i] else z)
        found.append((wrong, loss, decay))
    return min(found)[2]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit: Fit = Fit(),
    channel: Channel = Channel(),
) -> Model:
    """The model. Rows without a label, with a null id, or held out give no label; a repeated id has its mean label."""
    rows = id_and_text(docs, id_col, text_col)
    letters = LetterModel(letter_counts(rows))
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    marks = marks.filter("doc_id is not null and y is not null").filter(~held_out("doc_id"))
    marks = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows)
    # The bound makes this side small: fit.rows pairs of numbers.
    marked = rows.join(F.broadcast(stage(marks, "labels")), "doc_id").select("y", "text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters, channel)
        for part in parts:
            found = [list(features_in(restorer, text)) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("y"), pa.array(found, pa.list_(pa.string()))], ["y", "features"]
            )

    marked = stage(marked.mapInArrow(batches, "y int, features array<string>"), "features")
    total = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:  # nothing to tell apart
        return Model(letters, channel, {}, 6.0 if n1 else -6.0)
    counts = marked.select("y", F.explode("features").alias("f")).groupBy("f")
    counts = counts.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    # Only what marks the toxic class: the lack of ordinary words is no evidence, and a long text has them all.
    counts = counts.filter(f"a + b >= {fit.least_rows} and a * {n0} > b * {n1}")
    # Log-likelihood ratio of the feature and the class being independent.
    part = lambda x, of: f"({x}) * ln((({x}) + 1e-12) * {n0 + n1} / ((a + b) * {of}))"
    gone = lambda x, of: f"({of} - {x}) * ln(({of} - {x} + 1e-12) * {n0 + n1} / (({n0 + n1} - a - b + 1e-12) * {of}))"
    worth = F.expr(" + ".join([part("a", n1), part("b", n0), gone("a", n1), gone("b", n0)]))
    chosen = counts.withColumn("worth", worth).orderBy(F.desc("worth"), "f").limit(fit.features)
    names = sorted(r["f"] for r in chosen.select("f").collect())
    index = {f: i for i, f in enumerate(names)}

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            numbers = [sorted(index[f] for f in row if f in index) for row in part.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(numbers, pa.list_(pa.int64()))], ["y", "at"])

    data = sorted((r["y"], r["at"]) for r in marked.mapInArrow(numbered, "y int, at array<bigint>").collect())
    sets, classes = [r for _, r in data], np.array([y for y, _ in data], dtype=float)
    w, bias = fit_logistic(sets, classes, len(names), fit, choose_decay(sets, classes, len(names), fit))
    return Model(letters, channel, {f: float(w[i]) for f, i in index.items()}, bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher for likelier toxic. Null counts as empty; whole texts are read."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for part in parts:
            scores = [score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(batches, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows that score the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for part in parts:
            texts = part.column(part.schema.names.index(text_col)).to_pylist()
            yield part.filter(pa.array([score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


