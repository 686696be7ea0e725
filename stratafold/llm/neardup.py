"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. Each text's set of word shingles is hashed once; a bin of the hash space keeps its smallest hash, and an empty bin takes the value of
   the first filled bin in its own fixed random order (the same order for every text).  Bands of bins give the bucket keys.
2. Texts with equal sets are one node: a node is a distinct set, however many rows have it.
3. Within a bucket, edges go from one hub to the other members only, so a bucket of m members has m - 1 candidates.  The hub
   is the member that meets most others over all buckets: in a group of edited copies that is the original or close to it.
4. Candidates are confirmed on the full sets; confirmed links are closed to components.
5. A star alone would lose links between members that miss the hub.  So the members of buckets that still hold several components, their hubs left
   out, are joined exactly: shingles are ordered by how many of these texts have them, and only pairs of different components that share a
   shingle early enough in both orders (prefix, positional and size filters) are confirmed.  Copies that are edited too far from everything have
   shingles of their own first in order, and so are ruled out without being paired.

A pair at similarity 0.8 misses all of 32 bands of 4 bins with probability 5e-8, one at 0.9 with 1e-15.  Nothing is capped.  Groups of copies are
aggregated on the map side, hubs' members are dealt out by salted keys, and joins on bucket and component keys read stored tables, so that adaptive
execution can split hot keys.  Shared buckets, and the texts in
them whose full sets are built, are picked by bit arrays, sized by what they hold, before anything is shuffled by them.

Edge cases: a text without words, or null, has no shingles and links with nothing; fewer words than a shingle make one shingle; rows with a null id
link with nothing and are kept, with a null component; nodes are texts, so rows that repeat an id with another text are told apart, and
repeated rows get the same result; shingles are compared by 64-bit hashes, and rows are taken as one set by 128 bits of it; full sets are looked up by 64
of these. Columns besides those named are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bits import is_marked, marked
from ._spark import bound_batches, scratch, sliced, stored, texts_of, unnamed, with_fields
from ._text import NONSPACE, Words, gram_hashes, groups, mix64

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Shingles of the members that are held against a copy of their hub in one task.
DEALT = 1 << 15
_U = np.uint64


@cache
def _orders() -> np.ndarray:
    """For each bin, all bins in its own random order."""
    rng = np.random.default_rng(20140601)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, NONSPACE)
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        h = words.hashes[a:b]
        yield np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else h


def signature(shingles: np.ndarray) -> np.ndarray:
    """Band hashes of a non-empty set. The hashes are sorted, so the first of each bin is its smallest."""
    bins = (shingles >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _orders()[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = mix64(out ^ rows[:, j]) * _U(0xD6E8FEB86659FD93)
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = mix64(np.array([mix64(shingles).sum(dtype=np.uint64) + _U(len(shingles))]))[0]
    b = np.bitwise_xor.reduce(mix64(shingles ^ _U(0x5851F42D4C957F2D)), initial=_U(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (shingles), node and key2 (together the set's key) and bands, for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(1))
            n, keys, bands = [], [], []
            for a, b in groups(texts):
                for s in shingle_sets(texts[a:b], k):
                    n.append(len(s))
                    keys.append(set_key(s))
                    bands.append(signature(s).astype(np.int64) if len(s) else None)
            node, key2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(key2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "node", "key2", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "id bigint, n bigint, node bigint, key2 bigint, bands array<bigint>")


def _full_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: np.ndarray) -> DataFrame:
    """node and s, its shingles, for the texts whose id is marked in `wanted` (and a few more)."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that are repeated give their set once a task
        for batch in sliced(batches):
            here = np.flatnonzero(is_marked(bits.value, batch.column(0).to_numpy()))
            texts = texts_of(batch.column(1).take(pa.array(here)))
            for a, b in groups(texts):
                node, sets = [], []
                for s in shingle_sets(texts[a:b], k):
                    key = set_key(s)[0]
                    if len(s) and key not in seen:
                        seen.add(key)
                        node.append(key)
                        sets.append(s.astype(np.int64))
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    key = F.col(id_col).cast("bigint")
    rows = docs.filter(key.isNotNull()).select(F.xxhash64(key).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "node bigint, s array<bigint>")


def _once(sets: DataFrame) -> DataFrame:
    """Stored sets with one row for each node. Few come from several tasks, and only those are shuffled."""
    again = stored(sets.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").select("node"), "again")
    if again.isEmpty():
        return sets
    twice = sets.join(again, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))
    return stored(sets.join(again, "node", "left_anti").unionAll(twice), "sets")


def _in_bands(nodes: DataFrame, wanted: np.ndarray) -> DataFrame:
    """band, node and n, for the bands marked in `wanted` (and a few more)."""
    bits = nodes.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            at = np.flatnonzero(is_marked(bits.value, flat))
            row = pa.array(at // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(flat[at]), batch.column(0).take(row), batch.column(1).take(row)], names=["band", "node", "n"])

    return nodes.select("node", "n", "bands").mapInArrow(scan, "band bigint, node bigint, n bigint")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (hub, node, n) whose sets reach the similarity. Members are dealt out under salted copies of their hub."""
    load = stored(pairs.groupBy("hub").agg(F.ceil(F.sum("n") / DEALT).cast("int").alias("copies")), "load")
    copies = load.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("role"))
    dealt = pairs.join(load, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("role"))
    needed = stored(copies.unionAll(dealt), "needed")
    rows = needed.join(sets.hint("merge"), "node").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").select("hub", "salt", "role", "node", "s")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set, key = None, None
        for batch in batches:
            hubs, salts, roles, nodes = (batch.column(c).to_pylist() for c in ("hub", "salt", "role", "node"))
            lists = batch.column("s")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            out = []
            for i, (h, salt, role, node) in enumerate(zip(hubs, salts, roles, nodes, strict=True)):
                s = flat[at[i] : at[i + 1]].view(np.uint64)
                if role == 0:
                    hub_set, key = s.copy(), (h, salt)
                elif key == (h, salt):
                    where = np.minimum(np.searchsorted(hub_set, s), len(hub_set) - 1)
                    common = int((hub_set[where] == s).sum())
                    if 100 * common >= percent * (len(s) + len(hub_set) - common):
                        out.append((h, node))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(scan, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, for the nodes of stored edges (a, b): smallest neighbour labels and pointer jumping."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = stored(step, "step")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stored(step.join(jump, "comp").select("node", "old", F.col("next").alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and kept of each row."""
    return _decided(docs, id_col, text_col, shingle, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _decided(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, n, node, key2, component_id and kept of each row."""
    bound_batches(docs.sparkSession)
    with scratch() as keep:
        rows = stored(_signatures(docs, id_col, text_col, shingle), "rows")
        real = rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
        nodes = stored(real.groupBy("node", "key2", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "nodes")
        bands = nodes.select(F.explode("bands").alias("band"))
        shared = stored(bands.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
        # Bands of one node alone are most of them; those that the bit array knows for such aren't shuffled again.
        members = stored(_in_bands(nodes, marked(shared.select(F.col("band").alias("key")))).join(shared, "band"), "members")
        edges = _links(docs, nodes, members, id_col, text_col, shingle, percent)
        if edges is None:
            smallest = stored(nodes.select("node", "key2", "n", F.col("id").alias("component_id")), "smallest")
        else:
            found = components(edges)
            placed = stored(nodes.join(found, "node", "left").select("node", "key2", "n", "id", F.coalesce("comp", "node").alias("comp")), "placed")
            least = stored(placed.groupBy("comp").agg(F.min("id").alias("component_id")), "least")
            smallest = stored(placed.join(least, "comp").select("node", "key2", "n", "component_id"), "smallest")
        keep(rows, smallest)
    linked = real.select("id", "n", "node", "key2").join(smallest, ["node", "key2", "n"]).select("id", "n", "node", "key2", "component_id")
    alone = rows.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", "node", "key2", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionAll(alone).withColumn("kept", kept)


def _links(docs: DataFrame, nodes: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame | None:
    """Confirmed links (a, b), enough to connect all that is linked; None if there are none."""
    if members.isEmpty():
        return None
    first = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.xxhash64("id").alias("key")), "first")
    sets = _once(stored(_full_sets(docs, id_col, text_col, shingle, marked(first)), "sets"))
    # Stars: in each bucket, from the member with most company to the others.
    degree = stored(members.groupBy("node").agg(F.sum("c").alias("weight")), "degree")
    weighed = stored(members.join(degree, "node").select("band", "node", "n", "weight"), "weighed")
    hubs = stored(weighed.groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("h")).select("band", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    fits = (F.col("n") * percent <= F.col("hub_n") * 100) & (F.col("hub_n") * percent <= F.col("n") * 100)
    stars = weighed.join(hubs, "band").filter((F.col("node") != F.col("hub")) & fits)
    # A pair that is met in several buckets, or from either side, is tested once.
    stars = stars.groupBy(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y")).agg(F.min(F.struct("hub", "node", "n")).alias("p"))
    links = stored(_confirm(stored(stars.select("p.*"), "stars"), sets, percent), "links")
    # The rest: buckets that hold several components among the members that were no hubs there.
    rest = stored(weighed.join(hubs, (weighed.band == hubs.band) & (weighed.node == hubs.hub), "left_anti").select("band", "node", "n"), "rest")
    if links.isEmpty():
        placed = rest.withColumn("comp", F.col("node"))
    else:
        placed = rest.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed, "placed")
    mixed = stored(placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band"), "mixed")
    left = stored(placed.join(mixed, "band", "left_semi").select("node", "n", "comp").distinct(), "left")
    pairs = _prefix_pairs(left, sets, percent)
    if pairs is not None:
        more = stored(_confirm(pairs, sets, percent), "links")
        links = links.unionAll(more)
    return None if links.isEmpty() else stored(links, "links")


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Pairs (hub, node, n) of different components in `left` that can reach the similarity: an exact prefix join.

    Shingles are ordered by their number of nodes in `left`, rarest first. Two sets that have enough in common share a shingle at such places
    p and q of theirs that min(n - p, m - q) reaches the overlap they need. What is in one component on both sides, or too far back for
    the smallest partner, goes before anything is paired.
    """
    if left.isEmpty():
        return None
    wanted = left.sparkSession.sparkContext.broadcast(marked(left.select(F.col("node").alias("key"))))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(is_marked(wanted.value, batch.column(0).to_numpy()))
            part = batch.take(pa.array(at))
            sizes = part.column(1).value_lengths().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), part.column(1).flatten()], names=["node", "x"])

    # Shingles of one node alone only count as places before all others.
    every = stored(sets.mapInArrow(explode, "node bigint, x bigint"), "shingles").join(left, "node")
    common = stored(every.groupBy("x").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("c > 1"), "common")
    order = Window.partitionBy("node").orderBy("c", "x")
    shared = every.join(common, "x").withColumn("i", F.row_number().over(order)).withColumn("k", F.count("*").over(Window.partitionBy("node")))
    # Rank from the end: how many shingles, this one included, can be common if this is the first that is.
    reach = F.col("n") - (F.col("n") - F.col("k")) - F.col("i") + 1
    entries = shared.withColumn("reach", reach).filter((F.col("lo") != F.col("hi")) & _enough("reach", "n", "least", percent)).select("x", "node", "n", "comp", "reach")
    entries = stored(entries, "entries")
    about = stored(entries.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("most")).filter("lo <> hi"), "about")
    entries = stored(entries.join(about, "x").filter(_enough("reach", "n", "least", percent)).select("x", "node", "n", "comp", "reach"), "entries")
    other = entries.select("x", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("comp").alias("far"), F.col("reach").alias("span"))
    met = entries.join(other, "x").filter((F.col("comp") < F.col("far")) & _enough(F.least("reach", "span"), "n", "m", percent)).select("hub", "node", "n")
    return stored(met.distinct(), "pairs")


def _enough(common, n, m, percent: int) -> Column:
    """Whether so many common shingles are enough for sets of n and m."""
    common, n, m = (F.col(c) if isinstance(c, str) else c for c in (common, n, m))
    return common * (100 + percent) >= (n + m) * percent


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns of `docs`; of repeated rows, one."""
    inner = unnamed(docs)
    key, text = (inner.columns[docs.columns.index(c)] for c in (id_col, text_col))
    marks = stored(_decided(inner, key, text, SHINGLE, PERCENT).filter("id is not null").select(F.col("id").alias(key), "node", "key2", "kept"), "marks")
    gone = stored(marks.groupBy(F.col(key).alias("_gone")).agg(F.bool_or("kept").alias("_some"), F.bool_and("kept").alias("_all")).filter("not _all").select("_gone", "_some"), "gone")
    bits = inner.sparkSession.sparkContext.broadcast(marked(gone.select(F.xxhash64("_gone").alias("key"))))

    @F.pandas_udf("boolean")
    def known(hashed: pd.Series) -> pd.Series:
        return pd.Series(is_marked(bits.value, hashed.to_numpy()))

    # Only rows that the bit array knows are shuffled to be looked up; all others stay where they are.
    may_go = F.col(key).isNotNull() & known(F.xxhash64(F.col(key).cast("bigint")))
    out = inner.filter(~may_go).unionAll(inner.filter(may_go).join(gone, F.col(key) == F.col("_gone"), "left_anti"))
    # An id with texts of both kinds loses only those that aren't kept, so its rows are looked up by their sets too.
    mixed = gone.filter("_some").select("_gone")
    if not mixed.isEmpty():
        dropped = marks.filter("not kept").select(F.col(key).alias("_gone"), F.col("node").alias("_node"), F.col("key2").alias("_key2")).distinct()
        rows = _with_sets(inner.filter(may_go).join(mixed, F.col(key) == F.col("_gone"), "left_semi"), text, SHINGLE)
        same = (F.col(key) == F.col("_gone")) & (F.col("_set") == F.col("_node")) & (F.col("_set2") == F.col("_key2"))
        out = out.unionAll(rows.join(dropped, same, "left_anti").select(*inner.columns))
    again = marks.filter("kept").groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("c")).filter("c > 1").select("_again")
    if not again.isEmpty():
        again = stored(again, "again")
        twice = out.join(again, F.col(key) == F.col("_again"), "left_semi").dropDuplicates([key, text])
        out = out.join(again, F.col(key) == F.col("_again"), "left_anti").unionAll(twice)
    return out.toDF(*docs.columns)


def _with_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """The documents with `_set` and `_set2`, together the key of the text's set."""
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(text_col))
            keys = [set_key(s) for a, b in groups(texts) for s in shingle_sets(texts[a:b], k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([x[i] for x in keys], pa.int64()) for i in range(2))], names=[*columns, "_set", "_set2"])

    return docs.mapInArrow(scan, with_fields(docs.schema, "_set bigint, _set2 bigint"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2)
      JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
