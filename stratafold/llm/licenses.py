"""License scan: an exact set-similarity join between text blocks and license templates, in Spark expressions only.

A block is a line, or a run of words whatever lines they are on.  Blocks and templates are sets of words, ordered by document frequency in the whole
corpus, rarest first.  A block meets a template T when it holds at least ceil(threshold * |T|) of T's words.  Three filters stand
before the count of common words, and none of them loses a pair:

* prefix: a block that meets T holds one of the first |T| - need + 1 words of T;
* length: it has at least `need` words of the templates' vocabulary (others cannot be common words);
* position: a word at position i of n in the block and j of |T| in T leaves at most 1 + min(n - i, |T| - j) common ones.

A notice may be wrapped over lines.  So runs of words of the whole text are joined as well: each run as long
as T, that starts at a word of T, meets T when it holds `need` of T's words.  Runs are looked at where the whole text, taken as a block,
passes the three filters and holds `need` of T's words, which loses none either.

The templates are the small side and stand in the plan as literals, so the corpus is joined in the scan, without a
shuffle; only the frequencies of the templates' own words come to the driver.  Templates of more than MAX_TEMPLATE_WORDS words together
are dealt to several plans of so many.  The prefix filter runs first over whole texts: only those that hold a prefix word are cut into blocks.

Besides, places of three short phrases are counted (`base`), for which the word positions are returned.

Edge cases: a null text counts as empty and gets no label, zero places and score 0; repeated rows get a row each; there is no key,
so null or repeated ids change nothing; columns besides the text are passed by, but for those named as ours, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import unnamed

#: Words after lower-casing A-Z, as a pattern that matches either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates: label and text. The label says which licence's notice the line gives.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Most words of the templates in one plan, where they are literals; a single template may have more.
MAX_TEMPLATE_WORDS = 4000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  #: rarest first
    need: int
    length: int  #: words of the text, repeated ones too

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. lower() is the faster way where it makes no ASCII letters of other characters, which it does of these two only."""
    others = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """The words of a text in order, with an empty one at either end where the text doesn't begin or end with a word.

    Words with characters beyond ASCII may be in lower case throughout; templates are compared in the same form.
    """
    return F.split(lower_ascii(text), f"{GAP}+")


def words(text: Column) -> Column:
    return F.filter(split_words(text), lambda w: w != "")


def _template_words(text: str) -> frozenset[str]:
    return frozenset(_split(text))


def _split(text: str) -> list[str]:
    """The words of a template."""
    if not text.isascii():
        raise ValueError(f"templates are of ASCII characters: {text[:60]}")
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def order_templates(docs: DataFrame, text: Column, templates, threshold: float) -> tuple[list[Template], list[str]]:
    """Templates with their words by document frequency in `docs`, rarest first; and all words of templates in that order."""
    sets = [(label, _template_words(text), len(_split(text))) for label, text in templates]
    vocabulary = sorted(set().union(*(s for _, s, _ in sets)))
    found = docs.select(F.explode(F.array_intersect(_literal(vocabulary), split_words(text))).alias("w")).groupBy("w").count().collect()
    df = {r.w: r["count"] for r in found}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    out = [Template(label, tuple(sorted(s, key=rank.get)), math.ceil(threshold * len(s) - 1e-9), n) for label, s, n in sets if s]
    return out, sorted(vocabulary, key=rank.get)


def _literal(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _table(templates: list[Template]) -> Column:
    """The templates as one literal array, so that the plan has one expression for all of them."""
    return F.array(*(F.struct(F.lit(t.label).alias("label"), _literal(t.words).alias("words"), _literal(t.prefix).alias("prefix"), F.lit(t.need).alias("need"), F.lit(t.length).alias("length")) for t in templates))


def similar(block: Column, t: Column) -> Column:
    """How many words of template t the block, ordered words of the vocabulary, holds, if that is enough; else null."""
    n, m = F.size(block), F.size(t["words"])

    def can(word: Column, j: Column) -> Column:
        i = F.array_position(block, word)
        return (i > 0) & (F.least(n - i, m - j - 1) + 1 >= t["need"])

    common = F.size(F.array_intersect(block, t["words"]))
    return F.when((n >= t["need"]) & F.array_contains(F.transform(t["prefix"], can), True) & (common >= t["need"]), common)


def template_groups(templates, most: int) -> list[list[tuple[str, str]]]:
    """The templates in groups of at most so many words together, or of one that has more."""
    out: list[list[tuple[str, str]]] = []
    size = most
    for t in templates:
        n = len(_template_words(t[1]))
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


MATCHES, RUNS = "array<struct<block:int,label:string,containment:double>>", "array<struct<word:int,label:string,containment:double>>"


def scan_licenses(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns and n_words; `matches`: an array of (block, label, containment), lines from 0; and `runs`: for
    each template that some run of words meets, (word, label, containment) of the first of the fullest runs, words from 0.

    Columns of those names in `docs` are replaced.
    """
    added = ("n_words", "matches", "runs")
    docs = docs.drop(*added)
    inner, text = unnamed(docs), F.coalesce(F.col(f"_in{docs.columns.index(text_col)}"), F.lit(""))
    # Through explode() of one element the words are split once; as a plain column they would be, for each use of them.
    split = inner.select(*inner.columns, F.explode(F.array(split_words(text))).alias("_w"))
    parts = [_scan(inner, text, F.col("_w"), group, threshold) for group in template_groups(templates, MAX_TEMPLATE_WORDS)]
    both = [F.concat(F.array().cast(kind), *(p[i] for p in parts)) if len(parts) != 1 else parts[0][i] for i, kind in ((0, MATCHES), (1, RUNS))]
    ends = (F.element_at("_w", 1) == "").cast("int") + ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    return split.select(*inner.columns, (F.size("_w") - ends).cast("bigint"), *both).toDF(*docs.columns, *added)


def _scan(docs: DataFrame, text: Column, found: Column, templates, threshold: float) -> tuple[Column, Column]:
    """Matches of lines and of runs, for templates that fit in one plan. found: split_words() of the text."""
    ordered, vocabulary = order_templates(docs, text, templates, threshold)
    rare = _literal(sorted({w for t in ordered for w in t.prefix}))
    if not ordered:
        return F.array().cast(MATCHES), F.array().cast(RUNS)
    table = _table(ordered)

    def bound(value: Column, then) -> Column:
        """then(value), with the value taken once: transform() over an array of one element."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def met(line: Column, i: Column) -> Column:
        def of(block: Column, t: Column) -> Column:
            return bound(similar(block, t), lambda n: F.when(n.isNotNull(), F.struct(i.alias("block"), t["label"].alias("label"), (n / F.size(t["words"])).alias("containment"))))

        def each(w: Column) -> Column:
            return F.when(F.arrays_overlap(w, rare), bound(F.array_intersect(_literal(vocabulary), w), lambda block: F.array_compact(F.transform(table, lambda t: of(block, t)))))

        return bound(split_words(line), each)

    matches = F.flatten(F.array_compact(F.transform(F.split(text, "\n"), met)))

    def runs(w: Column) -> Column:
        def best(t: Column) -> Column:
            # Less the place, so that the first of equals is the largest.
            each = F.transform(w, lambda x, i: F.when(F.array_contains(t["words"], x), F.struct(F.size(F.array_intersect(F.slice(w, i + 1, t["length"]), t["words"])).alias("n"), (-i).alias("at"))))
            top = F.array_max(F.filter(each, lambda e: e["n"] >= t["need"]))
            return bound(top, lambda e: F.when(e.isNotNull(), F.struct((-e["at"]).alias("word"), t["label"].alias("label"), (e["n"] / F.size(t["words"])).alias("containment"))))

        return bound(F.array_intersect(_literal(vocabulary), w), lambda block: F.array_compact(F.transform(table, lambda t: F.when(similar(block, t).isNotNull(), best(t)))))

    wrapped = bound(F.filter(found, lambda w: w != ""), runs)
    holds = F.arrays_overlap(found, rare)
    return F.when(holds, matches).otherwise(F.array()).cast(MATCHES), F.when(holds, wrapped).otherwise(F.array()).cast(RUNS)


def phrase_pattern(phrase: str) -> str:
    return f"(?i)(?<!{WORD}){f'{GAP}+'.join(phrase.split())}(?!{WORD})"


def with_phrases(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The documents and n_base, first_word, last_word and base_labels (an array) of the phrases' places.

    Columns of those names in `docs` are replaced.
    """
    added = ("n_base", "first_word", "last_word", "base_labels")
    docs = docs.drop(*added)
    inner, text = unnamed(docs), F.coalesce(F.col(f"_in{docs.columns.index(text_col)}"), F.lit(""))
    anything = f"(?i)(?<!{WORD})(?:{'|'.join(f'{GAP}+'.join(p.split()) for p in phrases)})(?!{WORD})"
    # A cheap test before the patterns: the words of some phrase, in a lower-cased copy.
    may = F.lit(False)
    for p in phrases:
        both = F.lit(True)
        for w in p.split():
            both = both & F.contains(F.col("_low"), F.lit(w))
        may = may | both
    out = inner.withColumn("_low", F.lower(text)).withColumn("_may", may)
    # Between two places stand whole gaps, so the words of the parts are those of the text without the phrases'.
    out = out.withColumn("_parts", F.when(F.col("_may"), F.split(text, anything)).otherwise(F.array(F.lit(""))))
    out = out.withColumn("n_base", (F.size("_parts") - 1).cast("bigint"))
    found = F.col("n_base") > 0
    count = F.regexp_count
    out = out.withColumn("first_word", F.when(found, count(F.element_at("_parts", 1), F.lit(f"{WORD}+")).cast("bigint")))
    last = F.regexp_extract(text, f"(?s)^(.*){anything.removeprefix('(?i)')}".replace("(?s)", "(?is)"), 1)
    out = out.withColumn("last_word", F.when(found, count(last, F.lit(f"{WORD}+")).cast("bigint")))
    labels = F.array(*(F.when(found & text.rlike(phrase_pattern(p)), F.lit(label)) for p, label in phrases.items()))
    out = out.withColumn("base_labels", F.array_sort(F.array_distinct(F.array_compact(labels))))
    return out.select(*inner.columns, *added).toDF(*docs.columns, *added)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_phrases(scan_licenses(docs))
    met = F.concat(*(F.transform(c, lambda m: F.struct(m["label"].alias("label"), m["containment"].alias("containment"))) for c in ("matches", "runs")))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform(met, lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform(met, lambda m: m["containment"])), F.lit(0.0))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle() -> str:
    """The same result from plain set containment of every line, every run of words and every template, without the filters."""
    places = " UNION ALL ".join(
        f"SELECT r, p - 1 AS p, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p:p + {len(ws) - 1}] = {ws}"
        for ws, label in ((phrase.split(), label) for phrase, label in PHRASES.items())
    )
    sets = [(label, sorted(_template_words(text)), len(_split(text))) for label, text in TEMPLATES]
    templates = ", ".join(f"('{label}', {s}, {len(s)}, {math.ceil(THRESHOLD * len(s) - 1e-9)}, {n})" for label, s, n in sets)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_sql_words("coalesce(text, '')")} AS w FROM documents),
places AS ({places}),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
t(label, words, m, need, l) AS (VALUES {templates}),
holds AS (SELECT r, w, label, words, m, need, l FROM d, t WHERE len(list_intersect(list_distinct(w), words)) >= need),
blocks AS (SELECT r, list_distinct({_sql_words("line")}) AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
runs AS (SELECT r, label, len(list_intersect(list_distinct(w[p:p + l - 1]), words)) / m::DOUBLE AS c, need / m::DOUBLE AS least FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM holds)),
met AS (SELECT r, label, len(list_intersect(w, words)) / m::DOUBLE AS c FROM blocks, t WHERE len(list_intersect(w, words)) >= need UNION ALL SELECT r, label, c FROM runs WHERE c >= least),
all_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM met) GROUP BY r),
best AS (SELECT r, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels,
       coalesce(all_labels.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN all_labels USING (r) LEFT JOIN best USING (r)
"""


ORACLE = oracle()
