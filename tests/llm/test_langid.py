from __future__ import annotations

from stratafold.llm import langid

from .util import crc, nearest_language

WORDS = {"en": "the of and with that this from have which their would there been were", "de": "der die und nicht mit einer wurde haben ist auch nach über für können", "fr": "les des une est dans pour qui sur avec être cette mais leur était"}


def text(lang: str, i: int) -> str:
    ws = WORDS[lang].split()
    return " ".join(ws[(i * 7 + k * 3) % len(ws)] for k in range(30))


def test_held_out_rows_are_recognised(spark, tmp_path):
    rows = [(i, text(g, i), g, "x") for i, g in enumerate(["en", "de", "fr"] * 80)]
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "123 !! 4", "de", "x"), (1003, text("fr", 1), None, "x"), (None, text("de", 2), "en", "x"), (1004, text("en", 4) * 2000, "en", "x"), (1004, text("en", 4) * 2000, "en", "x")]
    spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, lang_pred string").write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op3_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == g and by[i].held_out == (crc(i) % 5 == 0) and 0 <= by[i].score <= 1 and not by[i].rejected for i, _, g, _ in rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "fr" and by[None].lang_pred == "de" and by[None].held_out and by[1004].lang_pred == "en"
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = langid.drop_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 3


def test_predictions_are_those_of_plain_loops(spark):
    rows = [(i, text(g, i) if i % 5 else text(g, i)[: i % 23], g) for i, g in enumerate(["en", "de", "fr"] * 40)] + [(900, "Ünïcödé ÇA, 日本 \u0130STANBUL 1x2y!", None), (901, "", None), (902, None, None), (903, "?", None), (904, "xq zz jjj kk", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.training_rows(docs, id_col="doc_id", text_col="text", lang_col="lang", per_language=langid.PER_LANGUAGE, texts=langid.TEXTS, languages=langid.LANGUAGES, longest=langid.LONGEST)
    model = langid.fit(sample)
    for r in langid.identify(docs).collect():
        lang, score, rejected = nearest_language(model, r.text, langid.FEATURES)
        assert (r.lang_pred, r.lang_rejected) == (lang, rejected) and abs(r.lang_score - score) < 1e-4, r.text


def test_a_language_that_was_not_learnt_is_rejected(spark):
    learnt = [(i, text(g, i), g) for i, g in enumerate(["en", "de"] * 150)]
    unknown = [(10_000 + i, text("fr", i), None) for i in range(150)]
    docs = spark.createDataFrame(learnt + unknown, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert sum(got[i].lang_rejected for i, _, _ in learnt) <= 3  # a quantile of 0.002, less a margin
    assert sum(got[i].lang_rejected for i, _, _ in unknown) > 140
    kept = {r.doc_id for r in langid.drop_unknown(docs).collect()}
    assert kept == {i for i, r in got.items() if not r.lang_rejected}


def test_the_sample_is_bounded_by_languages_and_texts(spark):
    docs = spark.createDataFrame([(i, text("en", i), f"l{i % 10}" if i < 900 else "rare") for i in range(910)], "doc_id bigint, text string, lang string")
    rows = list(langid.training_rows(docs, id_col="doc_id", text_col="text", lang_col="lang", per_language=600, texts=100, languages=10, longest=1000))
    assert {g for g, _ in rows} == {f"l{i}" for i in range(10)} and 40 < len(rows) < 200
    assert rows == list(langid.training_rows(docs.repartition(7), id_col="doc_id", text_col="text", lang_col="lang", per_language=600, texts=100, languages=10, longest=1000))


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(0, "abc", None)], "doc_id bigint, text string, lang string")
    (r,) = langid.identify(docs).collect()
    assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)
    assert langid.identify(docs.limit(0)).collect() == []


def test_long_texts_count_as_their_stretches():
    one, letters = langid.features(["ab cd ".encode() * 10])
    assert letters[0] == 40 and one.sum() > 0
