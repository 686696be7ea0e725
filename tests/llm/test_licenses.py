from __future__ import annotations

import random

from stratafold.llm import licenses

from .util import alnum_words


def brute(text):
    words = alnum_words(text)
    places = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    best, labels = 0.0, {label for _, label in places}
    for label, template in licenses.TEMPLATES:
        t, n = licenses._template_words(template), len(alnum_words(template))
        blocks = [set(alnum_words(line)) for line in (text or "").split("\n")] + [set(words[p : p + n]) for p in range(len(words))]
        for block in blocks:
            if len(block & t) >= licenses.THRESHOLD * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(block & t) / len(t))
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else best


def check(spark, folder, texts):
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, matches string, _low string").write.parquet(str(folder / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op2_licenses(spark, str(folder)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i][:6] == want[:6] and abs(got[i][6] - want[6]) < 1e-12, t
    return got


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "cc-by", "CC.\nBy CC BY", "ccby xcc by", "All rights reservedé all RIGHTS\treserved", "Kall rights reserved", "cc by " * 300]
    for label, t in licenses.TEMPLATES:
        ws = t.split()
        texts += [t, t.upper(), " ".join(reversed(ws)), " ".join(ws[: len(ws) * 4 // 5]), " ".join(ws[: len(ws) * 3 // 5]), "some line\n" + t + "\nthe end", t.replace(" ", "\n", 1)]
        rng.shuffle(ws)
        texts.append(" ".join([*ws[1:], "padding", "words", label]))
    check(spark, tmp_path, texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert licenses.with_phrases(licenses.scan_licenses(docs)).collect() == []


def test_words_of_whole_texts(spark, tmp_path):
    texts = [None, "", " ", "...", "one", "One two-three, ÄÖ 4five\n_six_", "all rights reserved", "a b all rights reserved c d cc by e", "w " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_words for r in licenses.op2_licenses(spark, str(tmp_path)).collect()}
    assert got == {i: len(alnum_words(t)) for i, t in enumerate(texts)}


def test_notices_wrapped_over_lines_against_brute_force(spark, tmp_path):
    import textwrap

    rng = random.Random(6)
    texts = [None, "", "the license", "mit\n\nlicense under\nthe released"]
    for label, t in licenses.TEMPLATES:
        for width in (20, 40, 75):
            texts += [textwrap.fill(t, width), "# " + textwrap.fill(t, width).replace("\n", "\n# "), "before it\n" + textwrap.fill("Some words and " + t + " More of the same.", width) + "\nafter"]
        ws = t.split()
        rng.shuffle(ws)
        texts += ["\n".join(ws), "\n".join(w + " x y" for w in ws), "\n".join(ws[: len(ws) * 3 // 5]), " the of\n" * 300 + t.replace(" ", "\n")]
    got = check(spark, tmp_path, texts)
    mit = texts.index(textwrap.fill(licenses.TEMPLATES[1][1], 40))
    assert got[mit][5:] == ("mit", 1.0)


def test_many_templates_in_several_plans(spark, monkeypatch):
    texts = [t for _, t in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, "\n".join([t, texts[i - 3]]), 0, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, runs int, _in1 int")
    want = sorted((r.doc_id, r._in1, sorted(r.matches), sorted(r.runs)) for r in licenses.scan_licenses(docs).collect())
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_WORDS", 30)
    assert len(licenses.template_groups(licenses.TEMPLATES, 30)) > 3
    assert sorted((r.doc_id, r._in1, sorted(r.matches), sorted(r.runs)) for r in licenses.scan_licenses(docs).collect()) == want
    assert licenses.scan_licenses(docs, templates=()).filter("size(matches) + size(runs) > 0").isEmpty()
