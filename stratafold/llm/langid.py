"""Language identification by nearest centroid.

A text is a bag of character bigrams and trigrams of its lower-cased letters (any run of other characters counts as one
boundary), hashed to a fixed number of features.  Counts are damped, weighted by inverse document frequency and scaled to
length one.  Each language has several centroids, from spherical k-means over its training texts; the prediction is the
language of the centroid with the largest cosine, and the score is that cosine.

A text is rejected when it has no letter, or when it is too far from the nearest centroid: its cosine is below the floor of the language predicted
for texts of its length.  Short texts share few n-grams with any centroid, so floors are learnt by class of length.  They come from texts that
the centroids haven't seen: those of either half of a language's sample are compared with centroids of the other half, and the floor is a low
quantile of their cosines, less a margin.  A class of length with too few texts has the floor of the next shorter one, or none.

The model is fitted on a bounded sample of labelled rows: the `languages` most frequent labels, `per_language` texts of each and `texts` of all
together, none longer than `longest` bytes, chosen by a hash of id and text.  Of these the driver holds n-gram counts, and one language's vectors at a
time.  Prediction reads all texts whole, in one pass without a shuffle; the model is broadcast, of 4 * CENTROIDS * FEATURES bytes a language.

Edge cases: a null text, or one without letters, is `und` with score 0 and rejected; rows with a null language don't train; a null
id counts as held out; with no training rows at all, every text is `und`; repeated rows get a row each; columns besides those named are
passed by, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_batches, fold, kept, sliced, texts_of, unnamed, with_fields
from ._text import groups

FEATURES = 1 << 13
#: Training texts of a language, of all languages, and the bytes of the longest; the most frequent languages that are learnt.
PER_LANGUAGE, TEXTS, LONGEST, LANGUAGES = 600, 9600, 20_000, 400
CENTROIDS = 4
#: Where classes of length begin, in n-grams, and texts that a class needs for a floor of its own.
LENGTHS, LEAST = (0, 32, 128, 512), 20
#: The quantile of unseen texts' cosines, and the share of it that is the floor.
QUANTILE, MARGIN = 0.002, 0.85
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, that of its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for lo, hi in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000)):
        for c in range(lo, hi):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):  # scripts without case
        out[lo:hi] = np.fromiter((c if chr(c).isalpha() else 0 for c in range(lo, hi)), np.uint32, hi - lo)
    return out


def features(texts: list[bytes | None], size: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row for each text, and the number of letters in each."""
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    out, letters = np.zeros((len(texts), size), np.float32), np.zeros(len(texts), np.int64)
    table = _letters()
    for i, t in enumerate(decoded):
        for part in range(0, len(t), 1 << 20):  # long texts in stretches that share a boundary
            c = table[np.frombuffer(t[part : part + (1 << 20)].encode("utf-32-le", "replace"), np.uint32)]
            letters[i] += np.count_nonzero(c)
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
            c = np.concatenate([[0], c[keep], [0]]).astype(np.uint32)
            two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
            for x in (two, three):
                x = x ^ (x >> np.uint32(15))
                x = x * np.uint32(0x2C1B3C6D)
                out[i] += np.bincount((x >> np.uint32(16)) & np.uint32(size - 1), minlength=size)
    return out, letters


def length_class(ngrams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, ngrams, side="right") - 1


class Model:
    """Centroids of the languages. `floors`: the least cosine that isn't rejected, by language and class of length."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray) -> None:
        self.langs, self.idf, self.centroids, self.owner, self.floors = langs, idf, centroids, owner, floors

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text."""
        counts, letters = features(texts, len(self.idf))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(counts, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(float)
        none = letters == 0
        score[none] = 0
        floor = self.floors[self.owner[best], length_class(counts.sum(axis=1))]
        return [UNKNOWN if n else self.langs[self.owner[b]] for n, b in zip(none, best, strict=True)], score, none | (score < floor)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else x[rng.integers(len(x))] for j in range(k)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _floors(x: np.ndarray, classes: np.ndarray, centroids: int, rng: np.random.Generator) -> np.ndarray:
    """Floors of a language by class of length, from halves that are held against each other's centroids."""
    out, unseen = np.zeros(len(LENGTHS)), np.zeros(len(x))
    if len(x) < 2:
        return out
    half = np.arange(len(x)) % 2
    for h in (0, 1):
        unseen[half == h] = (x[half == h] @ _cluster(x[half != h], centroids, rng).T).max(axis=1)
    for c in range(len(LENGTHS)):
        own = unseen[classes == c]
        out[c] = np.quantile(own, QUANTILE) * MARGIN if len(own) >= LEAST else out[c - 1] if c else 0.0
    return out


def fit(rows: Iterable[tuple[str, bytes]], size: int = FEATURES, centroids: int = CENTROIDS) -> Model:
    """A model from (language, text) pairs. Of the texts, their n-gram counts are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    seen, n = np.zeros(size, np.int64), 0
    for lang, text in rows:
        counts, letters = features([text], size)
        if letters[0]:
            at = np.flatnonzero(counts[0])
            held[lang].append((at.astype(np.uint16 if size <= 1 << 16 else np.uint32), counts[0, at]))
            seen[at] += 1
            n += 1
    langs = sorted(held)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    rng = np.random.default_rng(7)
    parts, floors = [], []
    for lang in langs:
        counts = np.zeros((len(held[lang]), size), np.float32)
        for i, (at, c) in enumerate(held.pop(lang)):
            counts[i, at] = c
        x = vectors(counts, idf)
        parts.append(_cluster(x, centroids, rng))
        floors.append(_floors(x, length_class(counts.sum(axis=1)), centroids, rng))
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    return Model(langs, idf, np.concatenate(parts) if parts else np.zeros((0, size), np.float32), owner, np.stack(floors) if floors else np.zeros((0, len(LENGTHS))))


def training_rows(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int, texts: int, languages: int, longest: int) -> Iterator[tuple[str, bytes]]:
    """About `per_language` rows of each language, fewer if there would be over `texts` together; the same ones, in the same order, however the table is laid out."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != 0) & (F.octet_length(text_col) <= longest))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()
    if not counts:
        return
    each = max(1, min(per_language, texts // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1 << 30, -(-(1 << 30) * each // r["count"]))) for r in counts], "lang string, below bigint")
    picked = rows.join(F.broadcast(shares), "lang").filter("h < below").select("lang", "h", "text").orderBy("lang", "h", "text")
    for r in picked.toLocalIterator():
        yield r.lang, r.text.encode()


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, texts: int = TEXTS, languages: int = LANGUAGES, longest: int = LONGEST) -> DataFrame:
    """The documents with all their columns and lang_pred, lang_score and lang_rejected, in place of columns of those names."""
    added = ("lang_pred", "lang_score", "lang_rejected")
    spark, docs = docs.sparkSession, docs.drop(*added)
    bound_batches(spark)
    inner = unnamed(docs)
    key, text, lang = (f"_in{docs.columns.index(c)}" for c in (id_col, text_col, lang_col))
    model = spark.sparkContext.broadcast(fit(training_rows(inner, id_col=key, text_col=text, lang_col=lang, per_language=per_language, texts=texts, languages=languages, longest=longest)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = texts_of(batch.column(text))
            lang, score, rejected = [], [], []
            for a, b in groups(found):
                for c in range(a, b, 128):
                    x, y, z = model.value.predict(found[c : min(c + 128, b)])
                    lang += x
                    score += y.tolist()
                    rejected += z.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *added])

    return inner.mapInArrow(scan, with_fields(inner.schema, "lang_pred string, lang_score double, lang_rejected boolean")).toDF(*docs.columns, *added)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def drop_unknown(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is recognised, with their columns."""
    return kept(docs, identify, ~F.col("lang_rejected"), id_col=id_col, text_col=text_col, lang_col=lang_col)
