"""The prefix tree of conversations against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from frameops.llm import prefix_trie
from frameops.llm.prefix_trie import Path, Trie


def brute(convs: dict[int, list[tuple[str, str]]]):
    nodes: dict[tuple, list[int]] = {}
    for conv in sorted(convs):
        for d in range(len(convs[conv]) + 1):
            nodes.setdefault(tuple(convs[conv][:d]), []).append(conv)
    rows = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        rows.append((
            members[0],
            len(path),
            nodes[path[:-1]][0] if path else None,
            len(members),
            sum(len(p) == len(path) + 1 for p in under),
            sum(not any(len(q) > len(p) and q[: len(p)] == p for q in nodes) for p in under),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(tree):
    return sorted((tuple(r) for r in tree.select(*COLUMNS).collect()), key=str)


def random_convs(rnd, n, longest):
    pool = [[("user", "é" * rnd.randint(0, 3) + str(rnd.randrange(2))) for _ in range(longest)] for _ in range(4)]
    convs = {}
    for c in rnd.sample(range(-50, 1000), n):
        turns = rnd.choice(pool)[: rnd.randint(0, longest)]
        turns = turns + [(rnd.choice("ab"), str(rnd.randrange(3))) for _ in range(rnd.randint(0, 2))]
        convs[c] = turns
    return convs


def table(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    said = spark.createDataFrame(rows, "conv_id bigint, pos bigint, role string, text string").repartition(5)
    return said, spark.createDataFrame([(c,) for c in convs], "conv_id bigint")


@pytest.mark.parametrize("seed", range(40))
def test_trie_of_one_batch(seed):
    rnd = random.Random(seed)
    trie, members = Trie(1), {}
    for conv in range(rnd.randint(1, 40)):
        start = rnd.choice([0, 0, 0, 16])
        turns = [rnd.randrange(2) for _ in range(rnd.randint(0, 16))]
        path = Path(start, 0 if start == 0 else rnd.randrange(2) + 5, turns, [1] * len(turns))
        trie.insert(path, conv, [1])
        for d in range(start + (start > 0), path.end + 1):
            members.setdefault(path.at(d), []).append(conv)
    got = {(d, h): (least, sums[0]) for d, h, _, _, least, sums in trie.expanded()}
    assert got == {k: (v[0], len(v)) for k, v in members.items()}


def test_fattest_numbers():
    for a in range(70):
        for b in range(a + 1, 70):
            f = prefix_trie.two_fattest(a, b)
            assert a < f <= b and (f & -f) == max(x & -x for x in range(a + 1, b + 1))


@pytest.mark.parametrize("length,turns_per_trie", [(1024, 200_000), (3, 7)])
def test_tree_against_brute_force(spark, length, turns_per_trie):
    convs = random_convs(random.Random(length), 60, 11)
    tree = prefix_trie.prefix_tree(*table(spark, convs), length=length, turns_per_trie=turns_per_trie)
    assert found(tree) == brute(convs)


def test_one_conversation_with_most_turns(spark):
    convs = {1: [("a", str(i % 7)) for i in range(900)], 2: [("a", str(i % 7)) for i in range(400)], 3: []}
    said, ids = table(spark, convs)
    tree = prefix_trie.prefix_tree(said, ids, length=64)
    rows = {(r.conv_id, r.depth): r for r in tree.collect()}
    assert len(rows) == 901 and rows[1, 0].n_convs == 3 and rows[1, 400].n_convs == 2 and rows[1, 401].n_convs == 1
    assert rows[1, 900].n_children == 0 and rows[1, 0].saved_tokens == 400 and rows[1, 390].saved_tokens == 11
    assert all(r.n_leaves == 1 and (r.depth == 0) == (r.parent_conv_id is None) for r in rows.values())


ROWS = [
    (7, 1, "assistant", "yes", "x", 1.0),
    (7, None, "user", "hi", "x", 1.0),
    (7, 1, "assistant", "yes", "x", 1.0),
    (8, 0, "user", "hi", None, None),
    (8, 3, None, None, None, None),
    (9, 2, "user", "hi", "x", 1.0),
    (9, 5, "", "", "x", 1.0),
    (None, 0, "user", "hi", "x", 1.0),
    (2, 0, "user", "long " * 100_000, "x", 1.0),
    (2, -4, "user", "hi", "x", 1.0),
]


def test_odd_rows(spark):
    odd = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string, hash string, n_convs double")
    said = prefix_trie.ordered(odd.repartition(3))
    convs = {
        7: [("user", "hi"), ("assistant", "yes"), ("assistant", "yes")],
        8: [("user", "hi"), ("", "")],
        9: [("user", "hi"), ("", "")],
        2: [("user", "hi"), ("user", "long " * 100_000)],
    }
    assert found(prefix_trie.prefix_tree(said)) == brute(convs)
    none = prefix_trie.ordered(odd.limit(0))
    assert found(prefix_trie.prefix_tree(none)) == []
    assert found(prefix_trie.prefix_tree(*prefix_trie.graft(odd.limit(0)))) == []
    renamed = odd.select(F.col("conv_id").alias("c"), "turn", "role", F.col("text").alias("t.x"), F.lit(1).alias("conv_id"))
    assert bool(said.exceptAll(prefix_trie.ordered(renamed, "c", text_col="t.x")).take(1)) is False
