"""The multi-index join of MinHash signatures against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from frameops.llm import minhash
from frameops.llm.minhash import Settings

S = Settings()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    members: dict[int, list] = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    least = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_signatures_share_a_key():
    rnd = np.random.default_rng(1)
    for settings in (S, Settings(symbols=24, chunk=4, most=17), Settings(symbols=20, chunk=2, most=9)):
        a = rnd.integers(0, 256, (400, settings.symbols)).astype(np.uint8)
        b = a.copy()
        for row in b:
            at = rnd.choice(settings.symbols, rnd.integers(0, settings.most + 1), replace=False)
            row[at] += rnd.integers(1, 256, len(at)).astype(np.uint8)
        assert ((a != b).sum(axis=1) <= settings.most).all()
        assert (minhash.bucket_keys(a, settings) == minhash.bucket_keys(b, settings)).any(axis=1).all()
    with pytest.raises(ValueError):
        Settings(symbols=64)


def test_signatures_differ_as_sets_do():
    rnd = np.random.default_rng(2)
    off = []
    for _ in range(300):
        h = rnd.integers(0, 1 << 63, 115 * 4).astype(np.uint64)
        a, b = minhash.signatures([np.unique(h[: 100 * 4]), np.unique(h[15 * 4 :])], S.symbols)  # 85 of 115 in common
        off.append((a != b).sum())
    share = (1 - 85 / 115) * 255 / 256
    assert abs(np.mean(off) / S.symbols - share) < 0.012
    assert np.std(off) < 1.3 * np.sqrt(S.symbols * share * (1 - share))


def family(rnd, n, words=90):
    """Texts that differ from one another in a few words, some of them too many for a link."""
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        text = list(rnd.choice(texts).split() if texts and rnd.random() < 0.5 else base)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("block,at_once", [(4096, 16_384), (5, 7)])
def test_components_against_brute_force(spark, block, at_once, monkeypatch):
    rnd = random.Random(block)
    texts = [t for n in (40, 12, 3, 2) for t in family(rnd, n)] + [f"only {i}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(rnd.sample(texts, len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(minhash.buckets, "__defaults__", (at_once,))
    assert found(minhash.near_duplicates(docs, block=block)) == brute(rows)


LONG = "lorem ipsum dolor sit amet " * 40_000
TEXT = "the quick brown fox jumps over the lazy dog and runs away"
ROWS = [
    (1, None, "x"),
    (2, "", None),
    (3, LONG, "x"),
    (4, LONG + "end", "x"),
    (5, TEXT, "x"),
    (5, TEXT, "x"),
    (5, "other text", "x"),
    (None, TEXT.upper(), "x"),
    (None, "ÉTÉ été", "x"),
    (None, None, "x"),
    (9, "Two\twords", "x"),
    (6, "two  words ", "x"),
    (7, "two words  ", "x"),
]


def test_odd_rows(spark):
    odd = spark.createDataFrame(ROWS, "doc_id bigint, text string, sid string").repartition(3)
    want = brute([r[:2] for r in ROWS])
    assert found(minhash.near_duplicates(odd)) == want
    assert (5, 10, 5, True) in want and (None, 10, 5, False) in want and (9, 1, 6, False) in want
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    named = odd.selectExpr("cast(doc_id as string) as label", "text as body", "1 as key")
    assert minhash.near_duplicates(named, "label", "body").filter("kept").count() == sum(r[3] for r in want)
