"""Runs of repeated words against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from frameops.llm import common, periodic_runs
from frameops.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """Every stretch of equal words q apart, for each q; only its smallest period counts."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        same = [words[t] == words[t + q] for t in range(len(words) - q)]
        t = 0
        while t < len(same):
            start = t
            while t < len(same) and same[t]:
                t += 1
            end = t + q
            if t > start and end - start >= max(least, exponent * q):
                smaller = (p for p in range(1, q) if all(words[i] == words[i + p] for i in range(start, end - p)))
                if next(smaller, None) is None:
                    found.append((start, end - start, q))
            t += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(1, 8)):
            letters = rnd.randint(1, 4)
            words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(0, 70))]
            if rnd.random() < 0.6:
                root = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
                at = rnd.randint(0, len(words))
                words[at:at] = (root * 6)[: rnd.randint(1, 6 * len(root))]
            texts.append(words)
        assert periodic_runs.find_runs(periodic_runs.numbered(texts)) == [brute(t) for t in texts]


def test_a_run_of_runs_and_a_long_one():
    inner = [b"a", b"b"] * 4 + [b"c"]
    texts = [inner * 5, [b"x"] * 300_000, [b"%d" % (i % 997) for i in range(40_000)]]
    first, second, third = periodic_runs.find_runs(periodic_runs.numbered(texts))
    assert first == brute(inner * 5) and (0, 45, 9) in first and len(first) == 6
    assert second == [(0, 300_000, 1)] and third == [(0, 40_000, 997)]


ROWS = [
    (1, None, "x", 1),
    (2, "", None, None),
    (3, "lorem ipsum dolor " * 50_000, "x", 1),
    (4, "so so so so so so what", "x", 1),
    (4, "so so so so so so what", "x", 1),
    (None, "no\tno  no\nno no no", "x", 1),
    (5, "a a a a a a a a a a", "x", 1),
]


def test_odd_rows(spark):
    odd = spark.createDataFrame(ROWS, "doc_id bigint, text string, runs string, collapsed int").repartition(3)
    found = periodic_runs.periodic_runs(odd)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    rows = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(rows, key=lambda r: (str(r[0]), r[2])) == [
        (1, [], ""),
        (2, [], ""),
        (3, [(0, 150_000, 3)], "lorem ipsum dolor"),
        (4, [(0, 6, 1)], "so what"),
        (4, [(0, 6, 1)], "so what"),
        (5, [], "a a a a a a a a a a"),
        (None, [(0, 6, 1)], "no"),
    ]
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    texts = odd.selectExpr("cast(doc_id as string) as name", "text as body")
    assert periodic_runs.periodic_runs(texts, "name", "body").filter("size(runs) = 1").count() == 4


def test_query_against_brute_force(spark):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = QUERIES["op12_periodic_runs"](spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in common.table(spark, DATA, "documents").collect()}
    assert len(rows) == len(docs)
    for row in rows:
        words = docs[row.doc_id].encode().split()
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 2_500:  # too long for brute force
            continue
        runs = brute(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert row.collapsed_sha256 == sha(kept)
