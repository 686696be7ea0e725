"""Best-fit packing of tokenised documents into sequences under several capacities.

A piece has three sizes: tokens, documents (1) and attention cost (tokens squared).  Each open sequence has what is left of each
capacity; a piece goes to the sequence that fits under all of them and is best by the chosen rule: the smallest weighted norm of
what would be left, or the largest weighted dot product of the piece's sizes with what is left.  Longest pieces go first.

All three sizes follow from the length, so pieces of one length are alike, and only the histogram of lengths (capacity many
numbers at most, however large the corpus) comes to the driver.  There, runs of sequences with the same remainder are packed at
once: a decision is "the next m pieces of length L, by rank, go to sequences b, b+1, ... at offset o".  Ranks are given in Spark: each
task numbers its pieces of each length, the numbers of all tasks are summed up to offsets, and a piece finds its decision by
binary search in the broadcast plan, which has a few rows for each length.  Runs are at most twice as many as lengths, however
many pieces there are, as a length ends within one run at most and opens one at most.  A capacity that neither binds nor weighs is left out.

`op8_packing` and the pipeline have limits of all three kinds, and weigh all three (WEIGHTS).  Their limits on documents and cost are the largest
that some sequence could need, so neither costs a sequence: they tell sequences apart that have about as many tokens left.

Tokens come from a public tokenizer's file, whose path is a parameter; a document is its ids and then the end id.  Tokens of one word don't depend
on its neighbours, so words are encoded once and kept; texts beyond Latin-1, or with a special token's string, go to the tokenizer whole.

Edge cases: a null or empty text is one piece, the end id; documents longer than the capacity are cut into full pieces and a rest; repeated rows
and null ids are packed like any; an empty table packs into nothing; columns to keep that are named as ours are replaced by ours.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._spark import bound_batches, sliced, stored, texts_of, with_fields
from ._text import groups

CAPACITY, END_ID = 4096, 1
#: Most documents and attention cost of a sequence, and what tokens, documents and cost weigh in the choice of one.
MAX_DOCS, MAX_COST, WEIGHTS = CAPACITY, CAPACITY**2, (1.0, 0.1, 0.1)
#: Words whose ids are kept in a worker: twice as many at most, as the last while's stay at hand.
KEPT = 200_000

# The tokenizer's own cut, for lower-cased Latin-1: contractions, letters, single digits, anything else but white space.
_LETTERS, _DIGITS, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}{_SPACE}]+")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end_id.to_bytes(4, "little")
        # Every word's last token, and no other, carries the mark of a word's end.
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words in strings of many, and cut their ids at the ends of words."""
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                self.kept.update((w, self.whole(w)) for w in part)
                continue
            data = ids.tobytes()
            self.kept.update(zip(part, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        cut: list[list[str] | str] = []
        for t in texts:
            text = (t or b"").decode("utf-8", "replace")
            cut.append(_CUT.findall(text.lower()) if _is_latin1(text) and not any(s in text for s in self.special) else text)
        seen = set(chain.from_iterable(c for c in cut if isinstance(c, list)))
        if len(self.kept) > KEPT:  # words of the last while stay at hand
            self.kept, self.older = {}, self.kept
        seen -= self.kept.keys()
        again = seen & self.older.keys()
        self.kept.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(list(seen - again))
        get = self.kept.__getitem__
        for words in cut:
            yield (b"".join(map(get, words)) if isinstance(words, list) else self.whole(words)) + self.end


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


#: Columns of pieces and of packed pieces.
OWN = ("piece", "start", "length", "ids_crc32", "task", "rank", "sequence_id", "offset")


def pieces(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Columns `keep`, but for those named as ours, and piece, start, length, ids_crc32, and the task and rank that number pieces of a length."""
    bound_batches(docs.sparkSession)
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    keep = tuple(c for c in keep if c.lower() not in OWN)
    inner = [f"_in{i}" for i in range(len(keep))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task, seen = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), defaultdict(int)
        for batch in sliced(batches, 4096):
            texts = texts_of(batch.column("_text"))
            rows = []
            for a, b in groups(texts, 2 << 20):
                for i, ids in enumerate(encode(texts[a:b]), a):
                    for start in range(0, len(ids), 4 * capacity):
                        part = ids[start : start + 4 * capacity]
                        n = len(part) // 4
                        rows.append((i, start // (4 * capacity), start // 4, n, zlib.crc32(part), seen[n]))
                        seen[n] += 1
            index, *columns = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 6
            kept = batch.select(inner).take(pa.array(index))
            numbers = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(np.full(len(index), task), pa.int64()), pa.array(columns[4], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *numbers], names=[*inner, *OWN[:6]])
        encode.older = {}  # later stages run in this worker too

    given = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in zip(keep, inner, strict=True)), F.col(f"`{text_col}`").alias("_text"))
    schema = with_fields(given.drop("_text").schema, "piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint")
    return given.mapInArrow(scan, schema).toDF(*keep, *OWN[:6])


class Plan:
    """Decisions: pieces of `length` with rank from `rank` on go to sequences from `first` on, at `offset`."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> None:
        caps = [capacity, max_docs if max_docs is not None else capacity, max_cost if max_cost is not None else capacity**2]
        # What neither binds (`capacity` tokens in pieces of any size cannot exceed it) nor weighs needs no account.
        binding = [True, *(cap < most or w > 0 for cap, most, w in zip(caps[1:], (capacity, capacity**2), weights[1:], strict=True))]
        bad = [n for n in histogram if n > capacity or n * n > caps[2]]
        if bad or caps[1] < 1:
            raise ValueError(f"pieces of {max(bad, default=0)} tokens fit under no capacity")
        scale = [w / c for w, c in zip(weights, caps, strict=True)]
        ends: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # what is left -> runs of sequences (first, count)
        rows, bins = [], 0
        left_of = np.zeros((3, 256))  # the states that there are, one a column, without gaps
        keys: list[tuple[int, int, int]] = []
        slot: dict[tuple[int, int, int], int] = {}

        def put(state: tuple[int, int, int], run: tuple[int, int]) -> None:
            nonlocal left_of
            if state not in ends:
                ends[state] = []
                slot[state] = len(keys)
                if len(keys) == left_of.shape[1]:
                    left_of = np.concatenate([left_of, np.zeros_like(left_of)], axis=1)
                left_of[:, len(keys)] = state
                keys.append(state)
            ends[state].append(run)

        def forget(state: tuple[int, int, int]) -> None:
            del ends[state]
            at, last = slot.pop(state), keys.pop()
            if last != state:  # the last takes its column
                keys[at], slot[last] = last, at
                left_of[:, at] = left_of[:, len(keys)]

        def best(size: tuple[int, int, int]) -> tuple[int, int, int] | None:
            """The state that is best for a piece; None if none has room."""
            value, fits = 0.0, True
            for left, n, weight, bind in zip(left_of[:, : len(keys)], size, scale, binding, strict=True):
                if bind:
                    rest = left - n
                    fits = (rest >= 0) & fits
                    if weight:
                        value = value + ((rest * weight) ** 2 if rule == "norm" else left * (-n * weight**2))
            if not np.any(fits):
                return None
            return keys[int(np.where(fits, value, np.inf).argmin())]

        for n in sorted(histogram, reverse=True):
            left, rank = histogram[n], 0
            size = n, 1 if binding[1] else 0, n * n if binding[2] else 0
            while left:
                state = best(size) if keys else None
                if state is not None:
                    first, count = ends[state].pop()
                    m = min(left, count)
                    if m < count:
                        ends[state].append((first + m, count - m))
                    elif not ends[state]:
                        forget(state)
                else:
                    # As many new sequences as these pieces need; the next turns fill them up.
                    state = caps[0], caps[1] if binding[1] else 0, caps[2] if binding[2] else 0
                    each = min(c // x for c, x in zip(state, size, strict=True) if x)
                    first, m = bins, -(-left // each)
                    bins += m
                rows.append((n, rank, first, capacity - state[0]))
                after = state[0] - size[0], state[1] - size[1], state[2] - size[2]
                if after[0]:
                    put(after, (first, m))
                left, rank = left - m, rank + m
        rows.sort()
        self.sequences = bins
        self.length, self.rank, self.first, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4
        self.key = (self.length << 44) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and rank among pieces of that length."""
        at = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        return self.first[at] + rank - self.rank[at], self.offset[at]


def pack(parts: DataFrame, capacity: int = CAPACITY, **rules) -> DataFrame:
    """pieces() with sequence_id and offset in place of task and rank."""
    spark = parts.sparkSession
    parts = stored(parts, "pieces")
    counts = parts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity, **rules))
    kept = [c for c in parts.columns if c not in ("task", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = plan.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ranked = parts.join(offsets, ["task", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, with_fields(parts.select(*kept).schema, "sequence_id bigint, offset bigint"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The digest of packing `docs`, which have doc_id and text."""
    out = pack(pieces(docs.select("doc_id", "text")), max_docs=MAX_DOCS, max_cost=MAX_COST, weights=WEIGHTS)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
