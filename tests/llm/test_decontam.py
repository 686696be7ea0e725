from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from stratafold.llm import decontam

from .util import alnum_words


def brute(text, items):
    words = alnum_words(text)
    hit, found = set(), set()
    for i, t in items:
        w = alnum_words(t)
        n = min(13, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                if i is not None:
                    found.add(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9))
def test_every_window_has_a_fingerprint(hashes, w):
    picked = set(decontam.winnow(np.array(hashes, np.uint64), w).tolist())
    for a in range(len(hashes) - w + 1):
        window = hashes[a : a + w]
        best = max(i for i, h in enumerate(window) if h == min(window))
        assert a + best in picked


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "dé", "9", "ha", "x_y"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 5, 12, 13, 14, 40]))) for i in range(12)] + [(100, None), (None, make(13)), (3, make(20)), (7, "ha " * 30)]
    texts = [None, "", "!!", "ha " * 200, *(make(rng.choice([1, 5, 13, 60, 300])) for _ in range(20))]
    texts += [f"{make(7)}.\n{t} {make(9)}" for _, t in items if t] * 2
    docs = spark.createDataFrame([(i % 40, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumnRenamed("extra", "extra")
    want = sorted((i % 40, *brute(t, items)) for i, t in enumerate(texts))
    for block in (decontam.BLOCK_BYTES, 150):
        found = decontam.report(decontam.find_overlaps(docs, bench, block_bytes=block))
        got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
        assert got == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(w[2] == 0 for w in want)


def test_planted_passages_go_however_long_the_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    make = lambda n: " ".join(word() for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((20, 13, 40, 9))]
    rows, planted = [], set()
    for i in range(40):
        n, item = rng.choice([30, 400, 5000]), items[i % 4][1]
        if i % 2:
            planted.add(i)
        rows.append((i, f"{make(n)} {item if i % 2 else make(30)} {make(n)}"))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == set(range(40)) - planted


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    (r,) = decontam.report(decontam.find_overlaps(docs, none)).collect()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
    assert decontam.report(decontam.find_overlaps(docs.limit(0), none)).collect() == []
