from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stratafold.llm import packing
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["don't I'LL 's'", "a\x85b\xa0c ² ½ ª º µ À É ß Ÿ", "\x1c\x1d", "‘q’ naïve", "<|endoftext|> x", "Σς İ 1234", "日本 a1b2 !!!? _-_", "''s '' 'sab", ""]


def ids(text: str | None) -> list[int]:
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x17F), max_size=40) | st.sampled_from(ODD), max_size=5))
def test_kept_words_give_the_tokenizers_ids(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODER([t.encode() for t in texts])]
    assert got == [ids(t) for t in texts]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=8), st.sampled_from([{}, {"max_docs": 3, "weights": (1, 1, 0), "rule": "dot"}, {"max_cost": 64 * 64 // 2 + 2048, "weights": (1, 0, 1)}]))
def test_plans_respect_every_capacity(histogram, rules):
    plan = packing.Plan(histogram, 64, **rules)
    length = np.concatenate([np.full(c, n) for n, c in histogram.items()]) if histogram else np.empty(0, np.int64)
    rank = np.concatenate([np.arange(c) for c in histogram.values()]) if histogram else np.empty(0, np.int64)
    bins = defaultdict(list)
    if len(length):
        for n, s, o in zip(length.tolist(), *(x.tolist() for x in plan.find(length, rank)), strict=True):
            bins[s].append((o, n))
    assert len(bins) == plan.sequences
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 64
        assert len(b) <= rules.get("max_docs", 64) and sum(n * n for _, n in b) <= rules.get("max_cost", 64 * 64)
    if not rules and histogram:  # best fit never leaves two sequences that would fit in one
        fills = sorted(sum(n for _, n in b) for b in bins.values())
        assert len(fills) < 2 or fills[0] + fills[1] > 64


def together(plan, a: int, b: int) -> bool:
    """Whether the first pieces of two lengths are in one sequence."""
    x, _ = plan.find(np.array([a, b]), np.array([0, 0]))
    return x[0] == x[1]


def test_documents_and_cost_choose_among_equal_tokens():
    # 70 and 35 + 35 leave 30 tokens each: fewer documents are left beside the two, less cost beside the one.
    histogram = {70: 1, 35: 2, 10: 1}
    assert together(packing.Plan(histogram, 100, max_docs=100, weights=(1, 1, 0)), 35, 10)
    assert together(packing.Plan(histogram, 100, max_cost=100**2, weights=(1, 0, 1)), 70, 10)
    assert together(packing.Plan(histogram, 100, max_docs=100, weights=(1, 1, 0), rule="dot"), 70, 10)
    assert together(packing.Plan(histogram, 100, max_cost=4999, weights=(1, 0, 0)), 35, 10)  # the other has no room for its cost


def test_the_query_weighs_all_three(spark):
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate((2867, 1433, 1433, 9))], "doc_id bigint, text string")
    got = {r.doc_id: r.sequence_id for r in packing.pack_documents(docs).collect()}
    assert got[1] == got[2] != got[0] == got[3]  # by tokens alone it is as near to the other


def test_plans_are_found_in_time():
    import time

    rng = np.random.default_rng(4)
    histogram = {int(n): int(c) for n, c in zip(range(1, 4097), rng.integers(1, 5000, 4096), strict=True)}
    began = time.perf_counter()
    plan = packing.Plan(histogram, max_docs=packing.MAX_DOCS, max_cost=packing.MAX_COST, weights=packing.WEIGHTS)
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    assert time.perf_counter() - began < 30 and plan.sequences <= least * 1.05 and len(plan.rank) < 60_000


def test_columns_that_are_named_as_ours_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8, "x")], "doc_id bigint, text string, rank int, start int, _text string")
    (r,) = packing.pack(packing.pieces(docs, keep=("doc_id", "rank", "start", "_text"))).collect()
    assert r.asDict() == {"doc_id": 1, "_text": "x", "piece": 0, "start": 0, "length": 2, "ids_crc32": zlib.crc32(np.array(ids("a"), "<u4").tobytes()), "sequence_id": 0, "offset": 0}


def test_pieces_that_fit_nowhere():
    with pytest.raises(ValueError, match="no capacity"):
        packing.Plan({65: 1}, 64)


def test_round_trip(spark, tmp_path):
    texts = [None, "", *ODD, "word " * 5000, "eins zwei " * 4096, *(f"text number {i} " * (i % 40) for i in range(300))]
    rows = [(i if i else None, t, 5) for i, t in enumerate(texts)] + [(3, "again", 5), (3, "again", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, rank int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op8_packing(spark, str(tmp_path)).collect()
    want = sorted(((i, k, k * 4096, len(part := x[k * 4096 : k * 4096 + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for i, t, _ in rows for x in [ids(t)] for k in range(-(-len(x) // 4096))), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert sum(n for _, n in p) <= 4096 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[0][0] == 0
    least = -(-sum(r.length for r in got) // 4096)
    assert len(places) <= least + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
