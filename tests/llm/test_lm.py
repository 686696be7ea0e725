from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from stratafold.llm import lm

TEXTS = ["The cat sat on the mat", "the cat  sat", "THE DOG sat on a mat . é É", None, "", "the cat sat on the mat " * 50, "x y 　 z"]


def tokens(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


@pytest.mark.parametrize("max_bytes", [lm.MAX_BYTES, 64])
def test_base_scores_and_known_tokens_match_brute_force(spark, max_bytes):
    rows = [(i, TEXTS[i % len(TEXTS)], "extra") for i in range(40)] + [(None, "the cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    held[None] = False
    counts = Counter(t for i, text, _ in rows if not held[i] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    from pyspark.sql import functions as F

    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    got = lm.score_texts(docs, train=train, max_bytes=max_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        ts = tokens(r.text)
        assert r.extra in ("extra", "x") and r.train_tokens == n and r.n_tokens == len(ts)
        assert r.n_known == sum(counts[t] > 0 for t in ts)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r.lm_score <= 0
    seen = [r for r in got if r.text and r.text.startswith("The cat sat")]
    assert all(r.lm_score > r.base_score for r in seen)


def test_filter_never_lowers_a_count():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 5000, len(keys))
    f = lm.Filter([lm.Filter.build(keys[keys >> np.uint64(62) == r], counts[keys >> np.uint64(62) == r], 4, 40) for r in range(4)])
    assert (f.estimate(keys) >= 1.5 * 2.0 ** (lm.Filter.levels(counts) - 1) - 0.5).all()
    absent = rng.integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.estimate(absent) > 0).mean() < 0.7 and 0 < f.full() < 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score_texts(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    (r,) = lm.score_texts(docs, train=F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("chunk", [1, lm.CHUNK_BYTES])
def test_filter_grows_with_its_pairs_and_both_ways_score_alike(spark, monkeypatch, chunk):
    import numpy as np

    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 100)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *TEXTS])], "doc_id bigint, text string").repartition(3)
    tables = {r.kind: r for r in lm.count_grams(docs, "text", 1).collect()}
    assert len(tables[2]["keys"]) * 8 > 0.9 * lm.BITS_EACH * tables[2].distinct
    want = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    # 2000 bytes hold neither the filter of 33,000 pairs nor the token counts, 10,000 the latter only.
    for max_bytes in (0, 2000, 10000):
        got = {r.doc_id: r for r in lm.score_texts(docs, max_bytes=max_bytes).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r[:5] == want[i][:5] and r.base_score == want[i].base_score and r.lm_score == want[i].lm_score
    # Pairs that were never seen stay improbable with a small max_bytes: almost all have no false hit.
    unseen = spark.createDataFrame([(i, f"w{i} x{i} w{i + 1}") for i in range(299)], "doc_id bigint, text string")
    both = docs.withColumn("t", F.lit(True)).unionByName(unseen.withColumn("t", F.lit(False)))
    far = {r.doc_id: r for r in lm.score_texts(both, train=F.col("t"), max_bytes=2000).filter("not t").collect()}
    assert np.mean([r.lm_score < r.base_score for r in far.values()]) > 0.9


def test_scores_are_those_of_exact_quantised_counts(spark, monkeypatch):
    """With a filter that has room enough to hold no false hit, scores are those of the pairs' own counts, in whichever way they are looked up."""
    monkeypatch.setattr(lm, "BITS_EACH", 4000)
    rows = [(i, t, "z", "y") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _chunk string, _row string").repartition(2)
    every = [tokens(t) for _, t, *_ in rows]
    one, two = Counter(t for ts in every for t in ts), Counter(p for ts in every for p in zip(["", *ts], ts))
    n, v = sum(one.values()), len(one)

    def exact(ts):
        total = 0.0
        for before, t in zip(["", *ts], ts):
            level = two[before, t].bit_length()
            e = min(1.5 * 2 ** (level - 1) - 0.5, one[before]) if level else 0.0
            total += math.log10(min(1.0, (e + lm.STRENGTH * (one[t] + 1) / (n + v + 1)) / (one[before] + lm.STRENGTH)))
        return total

    for max_bytes in (lm.MAX_BYTES, 0):
        got = lm.score_texts(docs, max_bytes=max_bytes).collect()
        assert len(got) == len(rows) and all(r._chunk == "z" and r._row == "y" for r in got)
        assert all(math.isclose(r.lm_score, exact(tokens(r.text)), rel_tol=1e-9, abs_tol=1e-12) for r in got)


def test_levels_run_to_the_largest_count():
    import numpy as np

    counts = np.array([1, 2, 3, 4, 65535, 65536, 1 << 20, (1 << 20) - 1, 10**9, 3 * 10**12])
    keys = np.arange(1, len(counts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert lm.Filter.levels(counts).tolist() == [int(c).bit_length() for c in counts]
    f = lm.Filter([lm.Filter.build(keys, counts, 1, 4000)])
    got = f.estimate(keys)
    assert (np.abs(got / counts - 1) <= 0.5).all()
