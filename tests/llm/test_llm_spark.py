"""The operators on odd rows, and the queries against SQL and brute force."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from helpers import bag
from pyspark.sql import functions as F

import corpus_pipeline
from frameops.llm import (
    ann,
    chat_format,
    common,
    components,
    decontaminate,
    packing,
    repeats,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from frameops.llm.queries import QUERIES, RANKS, SQL, TOKENIZER, VOCABULARY

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = "doc_id bigint, text string, spans string, fp double, ranges int, n_0 int"
SECRET = "token = 0123456789abcdef0123456789abcdef"
ROWS = [
    (1, None, "x", 1.0, 1, 1),
    (2, "", None, None, None, None),
    (3, LONG, "x", 1.0, 1, 1),
    (4, f"see {SECRET} you idiot", "x", 1.0, 1, 1),
    (4, f"see {SECRET} you idiot", "x", 1.0, 1, 1),
    (None, f"see {SECRET} you idiot", "x", 1.0, 1, 1),
    (5, "the quick brown fox jumps over the lazy dog and then runs far away from here", "x", 1.0, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


ALL_IDS = sorted((r[0] for r in ROWS), key=str)


def test_secrets_of_odd_rows(odd, empty):
    found = secret_scan.find_secrets(odd)
    assert ids(found) == ALL_IDS
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[1] == spans[2] == spans[3] == [] and spans[4] == [("assign", 4, 44), ("hex", 12, 44)]
    masked = secret_scan.redact_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == 7
    assert {r.text for r in masked.filter("doc_id = 4").collect()} == {"see [REDACTED] you idiot"}
    assert masked.filter("doc_id = 1 and text is null").count() == 1
    assert secret_scan.find_secrets(empty).count() == secret_scan.redact_secrets(empty).count() == 0


def test_simhash_of_odd_rows(odd, empty):
    found = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(d, c) for d, _, c in found} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, 4), (5, 5)}
    assert {f for d, f, _ in found if d in (1, 2)} == {0}
    assert ids(simhash.near_duplicates(odd)) == ALL_IDS
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 3, 4, 5]
    assert simhash.near_duplicates(empty).count() == simhash.keep_one_each(empty).count() == 0


def test_simhash_components_with_split_buckets(spark):
    base = common.table(spark, DATA, "documents")
    rows = simhash.fingerprints(base)
    near = rows.select("doc_id", F.col("fp").bitwiseXOR(F.lit(5)).alias("fp")).withColumn("doc_id", F.col("doc_id") + 10_000)
    rows = rows.unionAll(near)
    whole = bag(simhash.fingerprint_components(rows).collect(), ["fp", "root", "component_id"])
    split = bag(simhash.fingerprint_components(rows, block=2).collect(), ["fp", "root", "component_id"])
    data = sorted({(r.doc_id, r.fp % (1 << 64)) for r in rows.collect()})
    words = np.array([f for _, f in data], dtype=np.uint64)
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]) <= 4):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    want = {f: data[find(i)][0] for i, (_, f) in enumerate(data)}
    got = {r.fp % (1 << 64): r.component_id for r in simhash.fingerprint_components(rows).collect()}
    assert got == want and whole == split


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)} | {
        (i, 100) for i in [100, *range(200, 250)]
    }


def test_contamination_of_odd_rows(spark, odd, empty):
    items = [(1, "quick brown fox jumps over the lazy dog and then runs far away from"), (None, "You IDIOT"), (3, None)]
    items += [(4, "lorem ipsum"), (4, "lorem ipsum"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 20, 30):  # one block, and a block per item or two
        found = decontaminate.find_contamination(odd, bench, block_bytes=size)
        assert ids(found) == ALL_IDS
        rows = {r.doc_id: (r.n_words, [(x.start, x.end) for x in r.ranges], r.items) for r in found.collect()}
        assert rows[1] == rows[2] == (0, [], [])
        assert rows[3] == (200_000, [(i, i + 2) for i in range(0, 200_000, 5)], ["4"])
        assert rows[4] == rows[None] == (5, [(3, 5)], [""]) and rows[5] == (16, [(1, 15)], ["1"])
        left = decontaminate.remove_contamination(odd, bench, block_bytes=size)
        assert left.columns == odd.columns and ids(left) == [1, 2]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert ids(decontaminate.remove_contamination(odd, none)) == ALL_IDS
    assert decontaminate.find_contamination(empty, bench).count() == 0


def test_few_hits_are_cut_out(spark):
    text = "start " + "word " * 60 + "quick brown, fox! end"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "Quick Brown fox")], "item_id bigint, text string")
    assert decontaminate.remove_contamination(docs, bench, size=13).first().text == "start " + "word " * 60 + "! end"


def test_packing_of_odd_rows(odd, empty):
    pieces = packing.token_pieces(odd, TOKENIZER, RANKS, public_tokenizers.PATTERN)
    placed = packing.place_pieces(pieces).collect()
    assert {r.doc_id for r in placed} == set(ALL_IDS)
    assert [(r.length, r.start) for r in placed if r.doc_id in (1, 2)] == [(1, 0), (1, 0)]
    sequences: dict = {}
    for r in placed:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.place_pieces(packing.token_pieces(empty, TOKENIZER)).count() == 0


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(i, int(i == 4)) for i in range(1, 6)] + [(None, 1), (1, None)], "doc_id bigint, toxic int"
    )
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        model = toxicity.fit_toxicity(docs, marks, fit=toxicity.Fit(least_rows=1))
        scores = toxicity.score_toxicity(docs, model)
        assert ids(scores) == ids(docs) and scores.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_of_held_out_rows(spark):
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    found = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id)
    ranks, toxic = found.score.rank(), found.toxic == 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.8
    assert found[(found.predicted == 1)].toxic.mean() > 0.7


def test_token_counts_of_odd_rows(odd, empty):
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(odd, VOCABULARY).collect()}
    assert rows[1] == rows[2] == (0, 0) and rows[3][0] == 200_000
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0


def test_chats_of_odd_rows(spark):
    said = [
        (1, 0, "user", "hi <|im_end|>\n\\ <|"),
        (1, 1, "assistant", None),
        (2, None, None, "x"),
        (2, 5, "us\ner\\", "<\\|y"),
        (2, 5, "us\ner\\", "<\\|y"),
        (None, 0, "assistant", "alone"),
        *((3, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(200)),
        *((4, i, "user" if i != 150 else "system", str(i)) for i in (0, 150)),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in said], "conv_id bigint, turn bigint, role string, text string, state int")
    made = chat_format.format_chats(turns).select("*", chat_format.read_turns(F.col("formatted")).alias("turns"))
    rows = {r.conv_id: r for r in made.collect()}
    for conv in rows:
        own = [(r[2] or "", r[3] or "") for r in said if r[0] == conv]
        assert [(t.role, t.text) for t in rows[conv].turns] == own
        assert rows[conv].formatted == "".join(s.text for s in rows[conv].segments)
    assert {c: (r.valid, r.error_turn) for c, r in rows.items()} == {
        1: (True, None), 2: (False, 0), None: (False, 0), 3: (True, None), 4: (False, 1),
    }
    learned = made.select("conv_id", chat_format.learned_text(F.col("segments")).alias("t"))
    assert dict(map(tuple, learned.collect()))[3] == "".join(str(i) for i in range(1, 200, 2))
    assert chat_format.format_chats(turns.limit(0)).count() == 0
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_archives_of_odd_rows(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(1, "http://a.org/", page), (2, "http://b.org/", page), (3, None, None), (4, "http://a.org/", "short")]
    rows += [(5, "http://c.org/ä", "short"), (5, "http://c.org/ä", "short"), (None, "http://d.org", page), (6, "", LONG)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    captures = warc.write_archives(pages, f"{tmp_path}/warc")
    index = warc.build_index(captures, f"{tmp_path}/warc", f"{tmp_path}/index", lines_per_block=2)
    records = warc.read_records(warc.look_up(pages, index), index.archives)
    found = sorted(warc.payload_sizes(records).collect(), key=str)
    kinds = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found if r.page_id is not None)
    assert kinds == [
        (1, 203, "response", None), (2, 203, "revisit", 1), (3, 0, "response", None), (4, 5, "response", None),
        (5, 5, "response", None), (5, 5, "response", None), (6, len(LONG), "response", None),
    ]
    assert {r.payload_digest for r in found if r.page_id in (1, 2)} == {hashlib.sha256(page.encode()).hexdigest()}
    assert len(found) == 8
    one = warc.look_up(spark.createDataFrame([("https://A.org",), ("http://none.org/",)], "url string"), index)
    assert one.count() == 2  # both captures of that key
    none = warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    index = warc.build_index(none, f"{tmp_path}/none", f"{tmp_path}/none-index")
    assert warc.read_records(warc.look_up(pages, index), index.archives).count() == 0


def test_archives_with_repeated_ids_against_sql(spark, tmp_path):
    a, b = "A" * 203, "B" * 303
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (0, "B" * 99), (4, "B" * 99), (5, None), (5, a), (1, "C" * 150), (7, "C" * 150)]
    pages = spark.createDataFrame([(i, f"http://h{n % 3}.org/", h) for n, (i, h) in enumerate(rows)], "page_id bigint, url string, html string")
    captures = warc.write_archives(pages.repartition(3), f"{tmp_path}/warc")
    index = warc.build_index(captures, f"{tmp_path}/warc", f"{tmp_path}/index", lines_per_block=2)
    found = warc.payload_sizes(warc.read_records(warc.look_up(pages, index), index.archives))
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    want = db.execute(SQL["op4_warc"])
    columns = [c[0] for c in want.description]
    assert bag(found.collect(), found.columns) == bag(want.fetchall(), columns)


WHOLE = ann.Settings(shares=())  # windows of all vectors


def brute_nearest(vectors, k):
    keys, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=float)
    for i in np.flatnonzero(keys % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((keys, -s)) if j != i][:k]
        yield from ((int(keys[i]), r + 1, int(keys[j])) for r, j in enumerate(order))


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=6).round(3)]) for i in range(300)]
    good += [(1000 + i, good[40][1]) for i in range(60)]  # copies of a query's vector, queries among them
    bad = [(9000, None), (9020, [0.0] * 6), (9040, [float("nan")] * 6), (9060, [None] * 6), (None, good[0][1])]
    rows = [(i, v, 1.0) for i, v in good + bad + good[:3]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double")
    found = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, k=20, settings=WHOLE).collect()}
    assert found == set(brute_nearest(good, 20))
    few = spark.createDataFrame(rows[:3], df.schema)
    assert sorted((r.query_id, r["rank"]) for r in ann.nearest(few).collect()) == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="1 to 6 components"):
        ann.nearest(df.unionAll(spark.createDataFrame([(9080, [1.0], 1.0)], df.schema)))


def test_each_pair_in_a_window_is_compared_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    compared = spark.sparkContext.accumulator(0)
    found = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, settings=WHOLE, compared=compared).collect()}
    assert found == set(brute_nearest(rows, 20)) and compared.value == 45 * 900


def recall_and_pairs(spark, df, settings=ann.Settings()):
    compared = spark.sparkContext.accumulator(0)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df, settings=settings, compared=compared).collect()}
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = {(q, v) for q, _, v in brute_nearest(rows, 20)}
    return len(found & want) / len(want), compared.value / (len({q for q, _ in want}) * len(rows))


def test_recall_and_pairs_at_the_defaults(spark):
    recall, pairs = recall_and_pairs(spark, common.table(spark, "/root/testdata/sf0.1", "embeddings"))
    print(f"given vectors: recall {recall:.3f}, pairs {pairs:.3f}")
    assert recall >= 0.9 and pairs <= 0.8


def test_recall_and_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(200, 32))
    x = middles[rng.integers(0, 200, 50_000)] + 0.25 * rng.normal(size=(50_000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    pdf = pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()})
    df = spark.createDataFrame(pdf).selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    recall, pairs = recall_and_pairs(spark, df)
    print(f"clustered vectors: recall {recall:.3f}, pairs {pairs:.3f}")
    assert recall >= 0.9 and pairs <= 0.2


def test_recall_in_narrow_windows(spark):
    df = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    small = ann.Settings(block=64, sample=1024)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df, settings=small).collect()}
    want = {(q, v) for q, _, v in brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20)}
    assert len(found & want) / len(want) >= 0.9


def removed(rows, window=100):
    seen: dict = {}
    for doc, raw in sorted(rows):
        for s in range(len(raw) - window + 1):
            seen.setdefault(raw[s : s + window], (doc, s))
    for doc, raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - window + 1):
            if seen[raw[s : s + window]] < (doc, s):
                gone[s : s + window] = True
        yield doc, bytes(b for b, g in zip(raw, gone, strict=True) if not g)


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "collection": 3}])
def test_repeats_against_brute_force(spark, settings):
    docs = common.table(spark, DATA, "documents")
    found = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, **settings).collect()}
    assert found == dict(removed([(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]))


def test_repeats_of_odd_rows(odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL_IDS
    of = {r.doc_id: r for r in rows}
    # A period is 27 bytes long, so the window that begins there is the first that came before.
    assert bytes(of[3].kept) == LONG.encode()[:27] and of[1].n_bytes == of[2].n_bytes == 0
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.collect(), found.columns) == bag(want.fetchall(), columns)


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    docs = common.table(spark, DATA, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    counts = []
    for name, work in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        made = work(spark, docs, DATA)
        assert name == "packing" or made.dtypes == docs.dtypes
        made.write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        counts.append(docs.count())
        if name == "secrets":
            assert docs.count() == before.count()
            spans = secret_scan.find_secrets(docs).filter(F.size("spans") > 0)
            assert spans.count() == 0
            kept = {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs)
            assert groups.filter("doc_id <> component_id").count() == 0
    assert counts[0] >= counts[1] >= counts[2] == counts[3]
    assert {r.doc_id for r in docs.collect()} == kept
