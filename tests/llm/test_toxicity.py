from __future__ import annotations

import random

import numpy as np
from stratafold.llm import toxicity

from .util import crc, text_score


def test_gradients_match_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    xf, xb = rng.normal(0, 1, (6, 24)), rng.normal(0, 1, (6, 24))
    xf[0] = xb[0] = 0
    index = np.array([[1, 2, 3, 4], [5, 3, 0, 0]])

    def loss():
        return (net.forward(index, xf, xb).astype(np.float64) * np.array([1.0, -2.0])).sum()

    toxicity_float, toxicity.np.float32 = toxicity.np.float32, np.float64
    try:
        _, kept = net.forward(index, xf, xb, keep=True)
        grads, df, db = net.backward(np.array([1.0, -2.0]), kept)
        for table, grad in ((xf[1:], df), (xb[1:], db), *((net.p[k], grads[k]) for k in ("uf", "ub", "a", "v", "o", "z"))):
            for at in list(np.ndindex(*grad.shape))[:: max(1, grad.size // 20)]:
                old, e = table[at], 1e-5
                table[at] = old + e
                up = loss()
                table[at] = old - e
                down = loss()
                table[at] = old
                assert abs((up - down) / (2 * e) - grad[at]) < 1e-4
    finally:
        toxicity.np.float32 = toxicity_float


def test_windows_overlap_and_reach_the_end():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        owner, start, end = toxicity.windows_of(np.array([5, n]))
        spans = [(int(a), int(b)) for o, a, b in zip(owner, start, end, strict=True) if o]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= toxicity.WINDOW for a, b in spans)
        assert all(b >= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        if n > 64:
            inner = [sum(a <= p < b for a, b in spans) for p in range(toxicity.STRIDE, n - toxicity.WINDOW)]
            assert min(inner) >= 2


def test_held_out_rows(spark, tmp_path):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "do", "li", "ne", "ru") for b in ("ton", "mek", "sil", "par", "gu")]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.choice([10, 60, 200]))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = "gruks" + rng.choice(["o", "a", "elin", "ut"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad), 7))
    rows += [(900, None, "x"), (901, "", "x"), (902, "!?", "x"), (None, "baton domek", "x"), (903, "baton " * 30000 + "gruksa " + "domek " * 30000, "x"), (903, "baton", "x")]
    labels += [(904, 1, 7), (None, 1, 7), (0, None, 7)]
    spark.createDataFrame(rows, "doc_id bigint, text string, toxicity string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int, text int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(600) if crc(i) % 5 == 0]
    assert all(by[i].held_out for i in held) and sum(by[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert not by[900].predicted and not by[901].predicted
    assert max(r.predicted for r in got if r.doc_id == 903) == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = toxicity.drop_toxic(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert kept.columns == docs.columns and abs(kept.count() - (len(rows) - 151)) < 12


def test_scores_are_those_of_plain_loops(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Baton", "domek", "gruks", "é", "x9", "lila"]) for _ in range(n)) for n in (1, 2, 7, 31, 32, 33, 40, 49, 70)] + [None, "", "!!"]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, _in0 string, y int")
    labels = spark.createDataFrame([(i, int("gruks" in (t or ""))) for i, t in enumerate(texts)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, id_col="doc_id", text_col="text", label_id="doc_id", positives=toxicity.POSITIVES, negatives=toxicity.NEGATIVES, longest=toxicity.LONGEST)
    net = toxicity.train(rows).net
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(texts) and all(abs(r.toxicity - text_score(toxicity, net, r.text)) < 1e-4 and r._in0 == "n" for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.toxicity for r in toxicity.score_toxicity(docs, none).collect()] == [0.0]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []
