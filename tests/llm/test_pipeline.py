from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from stratafold.llm import decontam, langid, neardup, toxicity
from tokenizers import Tokenizer

from .util import alnum_words, nearest_language, space_words, text_score

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    keep = {
        "language": lambda d: {r.doc_id for r in langid.identify(d).collect() if not r.lang_rejected},
        "toxicity": lambda d: {r.doc_id for r in toxicity.score_toxicity(d, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.toxicity < 0.5},
        "near_duplicates": lambda d: {r.doc_id for r in neardup.near_duplicates(d).collect() if r.kept},
        "decontamination": lambda d: {r.doc_id for r in decontam.report(decontam.find_overlaps(d, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect() if r.n_hit == 0},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and {r.doc_id for r in out.collect()} == keep[name](docs)
        docs = corpus_pipeline.stored(out, name)
    left = {r.doc_id: r.text for r in docs.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in left.items()}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, held against plain loops: nearest centroids, the highest window, all pairs of sets, all windows of words."""
    rng = random.Random(31)
    words = {"en": [f"{a}{b}" for a in ("th", "wh", "sh") for b in ("e", "at", "ere", "is", "ing", "ould")], "de": [f"{a}{b}" for a in ("sch", "ein", "ge") for b in ("en", "ung", "keit", "lich", "über", "ach")]}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows, labels = [], []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        t = make(lang, rng.choice([20, 45, 80]))
        if i % 6 == 0:
            t = f"{t} gruksal {make(lang, 5)}"
        rows.append((i, t, lang))
        labels.append((i, int(i % 6 == 0)))
    items = [(k, make("en", n)) for k, n in enumerate((14, 20, 7))]
    rows += [(100 + k, f"{make('en', 30)} {t} {make('en', 200)}", "en") for k, (_, t) in enumerate(items)]
    rows += [(200 + i, rows[i][1] if i % 2 else rows[i][1] + " thatis", "en") for i in range(1, 40)]
    rows += [(300 + i, " ".join(rng.choice(["qqx", "zzvj", "xkq", "jjwq"]) for _ in range(150)), None) for i in range(4)] + [(400, None, "en"), (401, "", "de"), (402, "123 ...", None)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {i: t for i, t, _ in rows}

    def after(name):
        return {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()}

    def step(name, kept):
        nonlocal docs, left
        assert after(name) == kept and 0 < len(kept) < len(left), name
        docs, left = corpus_pipeline.stored(docs.filter(F.col("doc_id").isin(list(kept))), name), kept

    sample = langid.training_rows(docs, id_col="doc_id", text_col="text", lang_col="lang", per_language=langid.PER_LANGUAGE, texts=langid.TEXTS, languages=langid.LANGUAGES, longest=langid.LONGEST)
    model = langid.fit(sample)
    step("language", {i: t for i, t in left.items() if not nearest_language(model, t, langid.FEATURES)[2]})
    net = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), id_col="doc_id", text_col="text", label_id="doc_id", positives=toxicity.POSITIVES, negatives=toxicity.NEGATIVES, longest=toxicity.LONGEST)).net
    step("toxicity", {i: t for i, t in left.items() if text_score(toxicity, net, t) < 0.5})
    sets = {i: {tuple(w[k : k + 4]) for w in [space_words(t)] for k in range(max(1, len(w) - 3))} if space_words(t) else set() for i, t in left.items()}
    first = {i: i for i in left}
    for i in sorted(left):  # the smallest id that is reached, link by link
        for j in sorted(left):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = {k: low if x == high else x for k, x in first.items()}
    step("near_duplicates", {i: t for i, t in left.items() if first[i] == i})

    def holds(t):
        w = alnum_words(t)
        return any(w[p : p + n] == x[q : q + n] for _, item in items for x in [alnum_words(item)] for n in [min(13, len(x))] for q in range(len(x) - n + 1) for p in range(len(w) - n + 1))

    step("decontamination", {i: t for i, t in left.items() if not holds(t)})
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places: dict[int, list[tuple[int, int]]] = {}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in left.items())
    assert all(sum(n for _, n in p) <= 4096 and [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in places.values())


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e", None, None, 9), (2, "a b c d e", None, None, 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id bigint, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, str(tmp_path)).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert corpus_pipeline.distinct(spark, docs, "").count() == 3
