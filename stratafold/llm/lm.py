"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting.  Each task counts the hashes of the tokens and token pairs of its training texts and passes them on by hash range in
arrays; a range is then summed in one task, which holds one range at a time.  There are as many ranges as keep each of bounded size, RANGE_BYTES / 4 of text,
up to MOST_RANGES (that is 2 TB; beyond, a range grows with the corpus: at 100 TB it stands for 100 MB of text).  Counts of frequent n-grams arrive once a
task, so no range is hot.

Model.  A pair's count c is kept as its level 1 + floor(log2 c): the filter holds the pair under each level up to that, and a reader
probes levels 1, 2, ... until one misses; the last hit gives the count back as the middle of its range.  A wrong answer can only
raise a count, and each further level needs another false hit.  A pair's probes all fall in one 64-byte line, and each range of hashes
has a part of the filter of its own, built where the range is summed.  A part's size follows its distinct pairs, BITS_EACH bits for each,
however many there are, so the filter errs no more in a large corpus (Filter.full() tells how much).  Singletons are level 1 and held like
any other.

Scores.  A token's probability given the one before is interpolated from the pair's estimate and the token's own:
    p(w | v) = (e(v, w) + D * u(w)) / (c(v) + D),   u(w) = (c(w) + 1) / (N + V + 1)
with exact token counts c, N tokens and V distinct ones in training texts, and strength D.  `base_score` uses u alone.  The first token
of a text follows the mark that ends the text before.

Exact token counts are broadcast as sorted arrays while they are within MAX_BYTES, and the filter is while its parts together are.
Beyond that, the distinct n-grams of each chunk of texts go to their hash range's counts or part instead, and the answers come back to the
chunk.  Both ways give the same scores.

Edge cases: a null text counts as empty, and an empty text is its end mark; rows with a null id train, as crc32 is null and so not 2 for them;
without training rows every probability is 1; repeated rows count and are scored each; columns besides those named are passed by, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_batches, input_bytes, sliced, stored, texts_of, unnamed, with_fields
from ._text import NONSPACE, Words, groups, mix64

_U = np.uint64
#: The end mark's hash; any fixed number does.
END = _U(0x243F6A8885A308D3)
HELD_OUT_OF, HELD_OUT = 7, 2
BITS_EACH, PROBES = 10, 3
#: The level of the largest count that 64 bits with a sign hold.
LEVELS = 63
MAX_BYTES = 64 << 20
#: Bytes of text a range of hashes stands for, and n-grams counted in a task before they are passed on.
RANGE_BYTES, FLUSH = 8 << 20, 1 << 21
#: Most ranges, and most tasks among which they are dealt.
MOST_RANGES, MOST_TASKS = 1 << 20, 1 << 16
#: Bytes of text that ask for their n-grams together where those are not broadcast.
CHUNK_BYTES = 8 << 20
STRENGTH = 5.0
_LINE = 512


class Tokens:
    """Token hashes of some texts, each with its end mark; text i owns tokens at[i]:at[i + 1]."""

    def __init__(self, texts: list[bytes | None]) -> None:
        words = Words(texts, NONSPACE)
        self.at = words.at + np.arange(len(words.at))
        self.hashes = np.empty(self.at[-1], np.uint64)
        ends = self.at[1:] - 1
        inner = np.ones(len(self.hashes), bool)
        inner[ends] = False
        self.hashes[inner], self.hashes[ends] = words.hashes, END
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[self.at[:-1]] = END
        self.before = before

    def pairs(self) -> np.ndarray:
        return mix64(self.before * _U(0xD6E8FEB86659FD93) + self.hashes)


def _sum(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their (summed) counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """The ranges that ascending keys lie in, and where: range r holds keys[a:b]."""
    shift = _U(64 - ranges.bit_length() + 1)
    at = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << shift) if ranges > 1 else np.empty(0, np.int64)
    at = np.concatenate([[0], at, [len(keys)]])
    for r in np.flatnonzero(np.diff(at)).tolist():
        yield r, int(at[r]), int(at[r + 1])


def count_grams(docs: DataFrame, text_col: str, ranges: int) -> DataFrame:
    """Sums by kind (1 tokens, 2 pairs) and range: distinct n-grams and their total count; of tokens, keys and counts as bytes; of
    pairs, that range's part of the filter as keys.
    """

    def split(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        for r, a, b in _by_range(keys, ranges):
            yield kind, r, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()

    def batch_of(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        kind, r, keys, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(r, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "range", "keys", "counts"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [x for kind, parts in kept.items() for x in split(kind, *_sum(np.concatenate(parts)))]
            kept[1], kept[2] = [], []
            return batch_of(rows)

        for batch in sliced(batches):
            texts = texts_of(batch.column(0))
            for a, b in groups(texts):
                tokens = Tokens(texts[a:b])
                kept[1].append(tokens.hashes)
                kept[2].append(tokens.pairs())
                size += len(tokens.hashes)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by kind and range; what is held is one range, summed whenever it has doubled.
        key, keys, counts, due = None, [], [], 0

        def close() -> tuple[np.ndarray, np.ndarray]:
            return _sum(np.concatenate(keys), np.concatenate(counts))

        for batch in batches:
            for kind, r, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (kind, r) != key:
                    if key:
                        yield summed(key, *close())
                    key, keys, counts, due = (kind, r), [], [], 1 << 20
                keys.append(np.frombuffer(k, np.uint64))
                counts.append(np.frombuffer(c, np.uint32).astype(np.int64))
                if sum(map(len, keys)) > due:
                    k0, c0 = close()
                    keys, counts, due = [k0], [c0], max(1 << 20, 2 * len(k0))
        if key:
            yield summed(key, *close())

    def summed(key: tuple[int, int], k0: np.ndarray, c0: np.ndarray) -> pa.RecordBatch:
        kind, r = key
        if kind == 1:
            data = k0.tobytes(), c0.astype(np.int64).tobytes()
        else:
            lines = max(1, len(k0) * BITS_EACH // _LINE)
            data = Filter.build(k0, c0, ranges, lines).tobytes(), None
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([r], pa.int32()), pa.array([len(k0)], pa.int64()), pa.array([int(c0.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], names=["kind", "range", "distinct", "total", "keys", "counts"])

    parts = docs.select(text_col).mapInArrow(part, "kind int, range int, keys binary, counts binary")
    parts = parts.repartition(min(ranges, MOST_TASKS), "kind", "range").sortWithinPartitions("kind", "range")
    return parts.mapInArrow(total, "kind int, range int, distinct bigint, total bigint, keys binary, counts binary")


class Filter:
    """The log-frequency Bloom filter: for each range of hashes a part of its own, of whole lines of 64 bytes."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.lines = np.array([len(p) * 8 // _LINE for p in parts], np.uint64)
        self.first = np.cumsum(self.lines) - self.lines
        self.ranges = len(parts)
        self.data = np.concatenate(parts)

    @staticmethod
    def places(keys: np.ndarray, level: int) -> list[np.ndarray]:
        """Bits within a line for a level of the keys."""
        h = mix64(keys + _U(level * 0x9E3779B97F4A7C15 % 2**64))
        return [((h >> _U(9 * i)) & _U(_LINE - 1)).astype(np.int64) for i in range(PROBES)]

    @staticmethod
    def within(keys: np.ndarray, ranges: int) -> np.ndarray:
        """Where in its range a key lies, from 0 to 2**32 - 1."""
        return (keys << _U(ranges.bit_length() - 1)) >> _U(32)

    @staticmethod
    def levels(counts: np.ndarray) -> np.ndarray:
        return np.frexp(counts)[1].astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, ranges: int, lines: int) -> np.ndarray:
        """The bytes of a range's part, from its pairs."""
        bits = np.zeros(lines * _LINE, bool)
        line = (cls.within(keys, ranges) * _U(lines) >> _U(32)).astype(np.int64) * _LINE
        levels = cls.levels(counts)
        for level in range(1, int(levels.max(initial=0)) + 1):
            on = levels >= level
            for p in cls.places(keys[on], level):
                bits[line[on] + p] = True
        return np.packbits(bits, bitorder="little")

    @classmethod
    def probe(cls, data: np.ndarray, line: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, 0 if absent, from the lines at these bits of the data."""
        level = np.zeros(len(keys), np.uint8)
        live = np.arange(len(keys))
        for k in range(1, LEVELS + 1):
            hit = np.ones(len(live), bool)
            for p in cls.places(keys[live], k):
                at = line[live] + p
                hit &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            level[live] = k
        return level

    @classmethod
    def probe_part(cls, data: np.ndarray, keys: np.ndarray, ranges: int) -> np.ndarray:
        """Levels of keys that all lie in the range of this part."""
        lines = _U(len(data) * 8 // _LINE)
        return cls.probe(data, (cls.within(keys, ranges) * lines >> _U(32)).astype(np.int64) * _LINE, keys)

    @staticmethod
    def middle(level: np.ndarray) -> np.ndarray:
        """Counts for levels: 0, or the middle of the level's range."""
        return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.int64) - 1) - 0.5, 0.0)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs: 0, or the middle of the level's range."""
        r = (keys >> _U(64 - self.ranges.bit_length() + 1)).astype(np.int64) if self.ranges > 1 else np.zeros(len(keys), np.int64)
        line = ((self.within(keys, self.ranges) * self.lines[r] >> _U(32)) + self.first[r]).astype(np.int64) * _LINE
        return self.middle(self.probe(self.data, line, keys))

    def full(self) -> float:
        """Share of bits set; its PROBES-th power is the chance that an absent level seems present."""
        return float(np.bitwise_count(self.data).sum(dtype=np.int64) / max(1, 8 * len(self.data)))


class Scorer:
    """Scores texts, given exact token counts and the pairs' estimates."""

    def __init__(self, n: int, v: int, strength: float = STRENGTH) -> None:
        self.n, self.v, self.strength = n, v, strength

    def score(self, tokens: Tokens, counts: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base_score and score of each text. counts and before: of each token and of the one before it; pairs: estimates."""
        u = (counts + 1) / (self.n + self.v + 1)
        e = np.minimum(pairs, before)
        p = (e + self.strength * u) / (before + self.strength)
        first = tokens.at[:-1]
        return np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(np.log10(u), first), np.add.reduceat(np.log10(np.minimum(p, 1.0)), first)


def _look_up(keys: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), np.int64)
    unique, inverse = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(table, unique), len(table) - 1)
    return np.where(table[at] == unique, counts[at], 0).astype(np.int64)[inverse]


def _chunked(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with `_chunk`, the same for some neighbours; they are written down, so that it stays."""
    keep = docs.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 33, 0
        for batch in sliced(batches):
            texts = texts_of(batch.column(text_col))
            of = np.empty(len(texts), np.int64)
            for a, b in groups(texts):
                more = sum(len(t or b"") for t in texts[a:b])
                if size and size + more > CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
                of[a:b] = chunk
                size += more
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(of)], names=[*keep, "_chunk"])

    return stored(docs.mapInArrow(number, with_fields(docs.schema, "_chunk bigint")), "chunked")


def _answers(chunked: DataFrame, text_col: str, tables: DataFrame, ranges: int, kinds: tuple[int, ...]) -> DataFrame:
    """For each chunk, the distinct n-grams of these kinds as bytes and, for tokens, their counts, for pairs, their levels."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []
        chunk = None

        def close() -> pa.RecordBatch:
            rows = []
            for kind in kinds:
                keys = np.unique(np.concatenate([t.hashes if kind == 1 else t.pairs() for t in held]))
                rows += [(kind, r, chunk, keys[a:b].tobytes()) for r, a, b in _by_range(keys, ranges)]
            kind, r, of, keys = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(r, pa.int32()), pa.array(of, pa.int64()), pa.array(keys, pa.binary())], names=["kind", "range", "_chunk", "keys"])

        for batch in sliced(batches):
            texts, of = texts_of(batch.column(0)), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if held and of[start] != chunk:
                    yield close()
                    held = []
                chunk = int(of[start])
                held += [Tokens(texts[start + a : start + b]) for a, b in groups(texts[start:stop])]
        if held:
            yield close()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by kind and range, with the range's own row first; what is held is that row.
        key, table, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in sliced(batches):
            out: list[tuple[int, int, bytes, bytes]] = []
            for kind, r, chunk, k, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if chunk < 0:
                    key, table, counts = (kind, r), np.frombuffer(k, np.uint64 if kind == 1 else np.uint8), np.frombuffer(c or b"", np.int64)
                    continue
                keys = np.frombuffer(k, np.uint64)
                if kind == 1:
                    got = _look_up(keys, table, counts) if (kind, r) == key else np.zeros(len(keys), np.int64)
                else:
                    got = Filter.probe_part(table, keys, ranges) if (kind, r) == key else np.zeros(len(keys), np.uint8)
                out.append((chunk, kind, k, got.tobytes()))
            if out:
                chunk, kind, k, got = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(k, pa.binary()), pa.array(got, pa.binary())], names=["_chunk", "kind", "keys", "values"])

    asked = chunked.select(text_col, "_chunk").mapInArrow(ask, "kind int, range int, _chunk bigint, keys binary").withColumn("counts", F.lit(None).cast("binary"))
    held = tables.filter(F.col("kind").isin(*kinds)).select("kind", "range", F.lit(-1).cast("bigint").alias("_chunk"), "keys", "counts")
    both = held.unionByName(asked).repartition(min(ranges, MOST_TASKS), "kind", "range").sortWithinPartitions("kind", "range", "_chunk")
    return both.mapInArrow(answer, "_chunk bigint, kind int, keys binary, values binary")


def score_texts(docs: DataFrame, *, text_col: str = "text", train: Column | None = None, strength: float = STRENGTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents with all their columns and n_tokens, n_known, train_tokens, base_score and lm_score, in place of columns of
    those names.  `train` picks the rows to learn from; all of them if it is None.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "lm_score")
    given = docs.drop(*added)
    bound_batches(docs.sparkSession)
    learnt = docs.filter(train) if train is not None else docs
    docs, learnt, text_col = unnamed(given), unnamed(learnt.drop(*added)), f"_in{given.columns.index(text_col)}"
    sc = docs.sparkSession.sparkContext
    size = input_bytes(docs)
    if size > 1 << 50:  # the optimiser doesn't know
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = 1 << max(0, (max(1, min(MOST_RANGES, 4 * size // RANGE_BYTES)) - 1).bit_length())
    tables = stored(count_grams(learnt, text_col, ranges), "grams")
    words = tables.filter("kind = 1").select("range", "keys", "counts")
    v, n = tables.filter("kind = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    scorer = Scorer(n, v, strength)
    small = v * 12 <= max_bytes
    known, big = None, {}
    if small:
        rows = sorted(words.toLocalIterator(), key=lambda r: r.range)
        known = sc.broadcast((np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows] or [np.empty(0, np.uint64)]), np.concatenate([np.minimum(np.frombuffer(r["counts"], np.int64), 2**32 - 1).astype(np.uint32) for r in rows] or [np.empty(0, np.uint32)])))
        big = {int(k): int(c) for r in rows for k, c in _over(r)}
    pairs = tables.filter("kind = 2").select("range", "keys")
    light = (pairs.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) <= max_bytes
    filter_ = None
    if light:
        # Ranges without pairs have a line each.
        parts = [np.zeros(_LINE // 8, np.uint8)] * ranges
        for row in pairs.toLocalIterator():
            parts[row.range] = np.frombuffer(row["keys"], np.uint8)
        filter_ = sc.broadcast(Filter(parts))
    keep = docs.columns

    def scored(batch: pa.RecordBatch, given: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # given: keys and values by kind, for what is not broadcast
        texts = texts_of(batch.column(text_col))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in groups(texts):
            tokens = Tokens(texts[a:b])
            if small:
                counts = _look_up(tokens.hashes, *known.value)
                for k, c in big.items():
                    counts[tokens.hashes == _U(k)] = c
                end = _one(END, known.value, big)
            else:
                counts = _look_up(tokens.hashes, *given[1])
                end = int(counts[tokens.at[1] - 1])
            before = np.empty_like(counts)
            before[1:] = counts[:-1]
            before[tokens.at[:-1]] = end
            e = filter_.value.estimate(tokens.pairs()) if light else Filter.middle(_look_up(tokens.pairs(), *given[2]))
            for o, x in zip(out, (np.diff(tokens.at), *scorer.score(tokens, counts, before, e)), strict=True):
                o.append(x)
        numbers = [np.concatenate(o) if o else np.empty(0) for o in out]
        extra = [pa.array(numbers[0], pa.int64()), pa.array(numbers[1], pa.int64()), pa.array(np.full(len(texts), n), pa.int64()), pa.array(numbers[2], pa.float64()), pa.array(numbers[3], pa.float64())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *extra], names=[*keep, *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield scored(batch, {})

    def scan_chunk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        given: dict[int, list[tuple[bytes, bytes]]] = {1: [], 2: []}
        for kind, k, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            given[kind].append((k, x))
        tables = {}
        for kind, type_ in ((1, np.int64), (2, np.uint8)):
            keys = np.frombuffer(b"".join(k for k, _ in given[kind]), np.uint64)
            order = np.argsort(keys)
            tables[kind] = keys[order], np.frombuffer(b"".join(x for _, x in given[kind]), type_)[order]
        return pa.Table.from_batches([scored(batch, tables) for batch in sliced(iter(texts.to_batches()))])

    schema = with_fields(docs.schema, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, lm_score double")
    names = [*given.columns, *added]
    if small and light:
        return docs.mapInArrow(scan, schema).toDF(*names)
    chunked = _chunked(docs, text_col)
    answers = _answers(chunked, text_col, tables, ranges, tuple(kind for kind, here in ((1, small), (2, light)) if not here))
    return chunked.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(scan_chunk, schema).toDF(*names)


def _over(row) -> Iterator[tuple[int, int]]:
    """Tokens whose count doesn't fit in 32 bits."""
    counts = np.frombuffer(row["counts"], np.int64)
    at = np.flatnonzero(counts >= 2**32)
    return zip(np.frombuffer(row["keys"], np.uint64)[at].tolist(), counts[at].tolist(), strict=True)


def _one(key: np.uint64, known: tuple[np.ndarray, np.ndarray], big: dict[int, int]) -> int:
    return big.get(int(key), int(_look_up(np.array([key]), *known)[0]))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))
    out = score_texts(docs, train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("lm_score").alias("score"))
