"""Benchmark decontamination by winnowing.

Every item and every document is cut into words; k-gram hashes are winnowed: of each w consecutive k-grams the one with
the smallest hash (the rightmost on ties) is a fingerprint.  With w + k - 1 equal to the window length, any run of words
that has the length of a window and stands in both texts contains a common fingerprint.  Document fingerprints are joined
with item fingerprints by hash, and each hit is extended: all windows around it are looked up
among the items' windows, and confirmed word by word.  Items shorter than the window get a class of their own with a window of
their length, so that they are found too.

Items of up to `block_bytes` of text are one broadcast index, and the join runs inside the scan, without a shuffle.  Beyond that the items stay
distributed: bit arrays of their fingerprints and windows (_bits, of bounded size) pick the documents' windows around a common fingerprint, and
those are joined with the items' windows by hash and words, in a shuffle whose size follows the hits.  A document's row is found again by its text's
hash; only rows with hits move.  Both ways give the same results.

Edge cases: a null text has no words, and is never contaminated; an item with null text or without words
has no window; an item with a null id marks words, but isn't counted or listed; repeated documents each get a row;
repeated item ids count once; columns besides those named are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bits import is_marked, marked
from ._spark import bound_batches, kept, sliced, stored, texts_of, unnamed, with_fields
from ._text import ALNUM, Words, gram_hashes, groups, mix64

WINDOW = 13
#: Words of a fingerprinted k-gram; fewer for items shorter than that.
GRAM = 5
#: Most bytes of item text that are broadcast as an index.
BLOCK_BYTES = 8 << 20
#: A word, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SPANS = "array<struct<start:bigint,end:bigint>>"
FOUND = f"n_words bigint, spans {SPANS}, item_ids array<string>"


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some w consecutive ones, the rightmost on ties."""
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    windows = n - w + 1
    best, pos = grams[:windows].copy(), np.arange(windows)
    for k in range(1, w):
        better = grams[k : k + windows] <= best
        np.copyto(best, grams[k : k + windows], where=better)
        pos[better] = np.flatnonzero(better) + k
    return np.unique(pos)


class _Class:
    """Windows of one length of a block of items."""

    def __init__(self, length: int) -> None:
        self.length, self.k = length, min(GRAM, length)
        self.w = length - self.k + 1


class Index:
    """Fingerprints and windows of a block of items. Built on the driver, broadcast to the tasks."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.ids = [i for i, _ in items]
        self.words = words = Words([t for _, t in items], ALNUM)
        lengths = np.minimum(words.counts, window)
        self.classes = []
        for length in np.unique(lengths[lengths > 0]):
            c = _Class(int(length))
            owners = np.flatnonzero(lengths == length)
            prints, grams, items_of, where = [], [], [], []
            for i in owners:
                a, b = words.at[i], words.at[i + 1]
                h = words.hashes[a:b]
                g = gram_hashes(h, c.k)
                prints.append(g[winnow(g, c.w)])
                x = gram_hashes(h, c.length)
                grams.append(x)
                items_of.append(np.full(len(x), i))
                where.append(a + np.arange(len(x)))
            c.prints = np.unique(np.concatenate(prints))
            grams, items_of, where = (np.concatenate(x) for x in (grams, items_of, where))
            order = np.lexsort((items_of, grams))
            grams, items_of, where = grams[order], items_of[order], where[order]
            c.grams, first = np.unique(grams, return_index=True)
            c.first = np.append(first, len(grams))
            c.items = items_of
            c.where = where[first]
            self.classes.append(c)

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Number of words, hit spans (disjoint, ascending, in words) and ids of the items found, for each text."""
        words = Words(texts, ALNUM)
        owner = words.owner()
        n = len(texts)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for c in self.classes:
            grams = gram_hashes(words.hashes, c.k)
            if not len(grams):
                continue
            # Winnowing runs over the concatenated texts: a window of one text only is one of these windows, so its
            # fingerprint is kept; fingerprints of k-grams across two texts match nothing after confirmation.
            hits = winnow(grams, c.w)
            hits = hits[_member(grams[hits], c.prints)]
            if not len(hits):
                continue
            starts = _around(hits, c, words, owner)
            x = _grams_at(words.hashes, starts, c.length)
            at = np.minimum(np.searchsorted(c.grams, x), len(c.grams) - 1)
            ok = c.grams[at] == x
            for s, g in zip(starts[ok].tolist(), at[ok].tolist(), strict=True):
                if words.strings(s, s + c.length) == self.words.strings(c.where[g], c.where[g] + c.length):
                    spans, items = found.setdefault(int(owner[s]), ([], set()))
                    s -= int(words.at[owner[s]])
                    spans.append((s, s + c.length))
                    items.update(c.items[c.first[g] : c.first[g + 1]].tolist())
        for i in range(n):
            spans, items = found.get(i, ((), ()))
            yield int(words.counts[i]), merge_spans(spans), sorted({self.ids[j] for j in items} - {None})


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _grams_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes(words, n)[starts], without the others."""
    flat = words[starts[:, None] + np.arange(n)].ravel()
    return gram_hashes(flat, n)[::n] if len(starts) else np.empty(0, np.uint64)


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_overlaps(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns, and n_words, spans (of hit words) and item_ids (as strings, sorted).

    Columns of those names in `docs` are replaced.
    """
    docs = docs.drop("n_words", "spans", "item_ids")
    bound_batches(docs.sparkSession)
    inner, text = unnamed(docs), f"_in{docs.columns.index(text_col)}"
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = _in_scan(inner, rows, text, window) if size <= block_bytes else _joined(inner, rows, text, window)
    return found.toDF(*docs.columns, "n_words", "spans", "item_ids")


def _in_scan(docs: DataFrame, rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """With the items' index broadcast; the caller bounds their text."""
    index = docs.sparkSession.sparkContext.broadcast(Index([(r.i, r.t.encode()) for r in rows.toLocalIterator()], window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(text_col))
            n_words, spans, items = [], [], []
            for a, b in groups(texts):
                for n, s, i in index.value.find(texts[a:b]):
                    n_words.append(n)
                    spans.append([{"start": x, "end": y} for x, y in s])
                    items.append(i)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_words", "spans", "item_ids"],
            )

    return docs.mapInArrow(scan, with_fields(docs.schema, FOUND))


def _key(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of different lengths told apart, as the bit arrays take them."""
    return mix64(hashes + np.uint64(length) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _item_windows(rows: DataFrame, window: int) -> DataFrame:
    """length, key and words of the items' windows and i, the item's id; rows without words are fingerprints."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in groups(texts):
                words = Words(texts[a:b], ALNUM)
                length, key, said, item = [], [], [], []
                for i in range(b - a):
                    start, stop = int(words.at[i]), int(words.at[i + 1])
                    n = min(window, stop - start)
                    if not n:
                        continue
                    c, h = _Class(n), words.hashes[start:stop]
                    prints = gram_hashes(h, c.k)
                    prints = np.unique(prints[winnow(prints, c.w)])
                    grams = gram_hashes(h, n)
                    key += [_key(prints, n), _key(grams, n)]
                    length += [n] * (len(prints) + len(grams))
                    said += [None] * len(prints) + [b" ".join(words.strings(p, p + n)) for p in range(start, start + len(grams))]
                    item += [ids[a + i]] * (len(prints) + len(grams))
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(np.concatenate(key) if key else [], pa.int64()), pa.array(said, pa.binary()), pa.array(item, pa.string())], names=["length", "key", "words", "i"])

    return rows.mapInArrow(scan, "length int, key bigint, words binary, i string")


def _joined(docs: DataFrame, rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """With the items distributed, by joins on what bit arrays of their fingerprints and windows let through."""
    sc = docs.sparkSession.sparkContext
    held = stored(_item_windows(rows, window), "items")
    prints, windows = stored(held.filter("words is null").select("length", "key").distinct(), "prints"), stored(held.filter("words is not null").distinct(), "windows")
    classes = [_Class(r.length) for r in prints.select("length").distinct().orderBy("length").collect()]  # `window` at most
    known = sc.broadcast((marked(prints.select("key")), marked(stored(windows.select("key").distinct(), "keys"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in groups(texts):
                words = Words(texts[a:b], ALNUM)
                owner = words.owner()
                for c in classes:
                    grams = gram_hashes(words.hashes, c.k)
                    if not len(grams):
                        continue
                    hits = winnow(grams, c.w)
                    starts = _around(hits[is_marked(known.value[0], _key(grams[hits], c.length))], c, words, owner)
                    keys = _key(_grams_at(words.hashes, starts, c.length), c.length)
                    on = is_marked(known.value[1], keys)
                    starts, keys = starts[on].tolist(), keys[on]
                    if not starts:
                        continue
                    of = owner[starts].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[a + i] for i in of], pa.string()), pa.array([s - int(words.at[i]) for s, i in zip(starts, of, strict=True)], pa.int64()), pa.array([c.length] * len(starts), pa.int32()),
                         pa.array(keys, pa.int64()), pa.array([b" ".join(words.strings(s, s + c.length)) for s in starts], pa.binary())],
                        names=["doc", "start", "length", "key", "words"],
                    )

    named = docs.filter(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col).cast("binary")).alias("doc"), text_col)
    # Copies of a text give its windows once.
    met = stored(named.mapInArrow(scan, "doc string, start bigint, length int, key bigint, words binary").distinct(), "met")
    found = stored(met.join(windows, ["length", "key", "words"]).select("doc", "start", (F.col("start") + F.col("length")).alias("end"), "i"), "found")
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("doc", "start", "end").distinct().withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    ids = found.filter("i is not null").select("doc", "i").distinct().groupBy("doc").agg(F.sort_array(F.collect_list("i")).alias("item_ids"))
    hits = stored(spans.join(ids, "doc", "left").withColumnRenamed("doc", "_doc"), "hits")
    bits = sc.broadcast(marked(hits.select(F.xxhash64("_doc").alias("key"))))

    @F.pandas_udf("boolean")
    def hit(hashed: pd.Series) -> pd.Series:
        return pd.Series(is_marked(bits.value, hashed.to_numpy()))

    columns = docs.columns
    counted = docs.withColumn("n_words", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")).withColumn("_key", F.md5(F.col(text_col).cast("binary")))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema.fields[1:]]
    may = F.col("_key").isNotNull() & hit(F.xxhash64("_key"))
    out = counted.filter(~may).select(*columns, "n_words", *none).unionAll(counted.filter(may).join(hits, F.col("_key") == F.col("_doc"), "left").select(*columns, "n_words", "spans", "item_ids"))
    return out.select(*columns, "n_words", *(F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "item_ids")))


def _around(hits: np.ndarray, c: _Class, words: Words, owner: np.ndarray) -> np.ndarray:
    """The starts of the windows that hold one of these fingerprints, each within one text."""
    starts = np.unique((hits[:, None] - np.arange(c.w)).ravel())
    starts = starts[(starts >= 0) & (starts + c.length <= len(words.hashes))]
    return starts[owner[starts] == owner[starts + c.length - 1]]


def report(found: DataFrame) -> DataFrame:
    """The digest of find_overlaps(): n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("bigint"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(find_overlaps(docs, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents without any hit, with their columns. A long text with one whole passage goes too, though it isn't `contaminated` by its share."""
    return kept(docs, lambda d, text_col: find_overlaps(d, items, text_col=text_col), F.size("spans") == 0, text_col=text_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, p, array_to_string(w[p:p + l - 1], ' ') AS g
       FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT dw.r, dw.l, dw.p, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT r, l, p FROM hit)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
