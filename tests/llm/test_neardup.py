from __future__ import annotations

import random

import numpy as np
import pytest
from stratafold.llm import neardup

from .util import space_words


def shingles(text):
    w = space_words(text)
    n = min(4, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None, d is None or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  TWO"), (4, "one two three"), (None, "one two"), (5, "a b c d"), (5, "e f g h"), (6, "e f g h"), (6, "e f g h"), (7, "x " * 500), (8, "x " * 400)]
    n = 10
    for size in (12, 60, 200):
        base = [f"b{size}_{i}" for i in range(size)]
        for k in range(40):  # an original, copies, and copies that are edited less and more
            rows.append((n, edited(rng, base, k * size // 300)))
            n += 1
        chain = list(base)
        for k in range(8):  # each a little further from the first
            chain = edited(rng, chain, max(1, size // 60)).split()
            rows.append((n, " ".join(chain)))
            n += 1
    rows += [(n + k, " ".join(f"s{rng.randrange(2000)}" for _ in range(30))) for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, node string, n int").repartition(5)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # Of repeated rows one stays; id 5 has two texts, which are told apart.
    assert sorted(i for i in ids if i is not None) == sorted([*{w[0] for w in brute(rows) if w[3] and w[0] is not None}, 5]) and ids.count(None) == 1


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(200):
        x = rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = np.unique(x[:95]), np.unique(x[5:])
        same.append((neardup.signature(a) == neardup.signature(b)).mean())
    assert abs(np.mean(same) - 0.9**4) < 0.03
    one = neardup.signature(np.array([12345], np.uint64))
    assert len(one) == neardup.BANDS and (one == neardup.signature(np.array([12345], np.uint64))).all()


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(docs).collect() == []
    one = spark.createDataFrame([(9, "a b c")], "doc_id bigint, text string")
    assert [tuple(r) for r in neardup.near_duplicates(one).collect()] == [(9, 1, 9, True)]


def test_an_id_with_a_copy_keeps_its_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (7, a), (7, b), (7, a), (7, ""), (8, b), (8, b), (9, c), (9, b + " more"), (None, b)]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, b), (7, a), (7, ""), (9, c), (None, b)], key=str)
