"""Indexes of versioned tables: words and their rows for full-text search, cells of near vectors for vector search.

An index lies in the table's folder, and belongs to the snapshot it was built from; once the table has another, searches scan it until
the index is built again. Searches with an index give the rows that a scan gives. Indexes on plain columns hold nothing of their own: the
minima, maxima and dictionaries in the data files serve conditions on them.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import distance
from ..sources.snapshots import Snapshot, Table
from . import search

TEXT = ("INVERTED",)
VECTOR = ("IVF_FLAT", "IVF_PQ", "IVF_SQ", "IVF_RQ", "IVF_HNSW_FLAT", "IVF_HNSW_PQ", "IVF_HNSW_SQ")
#: Vectors from which cells are learnt, most cells, and rounds of learning.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 256, 8


def _folder(table: Table, name: str) -> str:
    return f"{table.path}/index/{name}"


def build(table: Table, name: str, kind: str, column: str, options: dict[str, str]) -> None:
    """Build an index on the table's last snapshot, in place of one of that name."""
    if kind not in TEXT + VECTOR:
        return
    s = table.snapshot()
    drop(table, name)
    rows = table._with_places(s)
    meta = _words(table, rows, name, column) if kind in TEXT else _cells(table, rows, name, column, options.get("metric_type", "l2"))
    if meta is None:  # nothing to find
        return
    table.fs.write(f"{_folder(table, name)}/index.json", json.dumps(meta | {"version": s.version, "column": column, "kind": kind}), overwrite=True)


def drop(table: Table, name: str) -> None:
    table.fs.delete(_folder(table, name))


def current(table: Table, names: list[str], kinds: tuple[str, ...], column: str, s: Snapshot, metric: str | None = None) -> tuple[str, dict] | None:
    """Folder and description of an index that holds for a snapshot; None if there is none."""
    for name in names:
        path = f"{_folder(table, name)}/index.json"
        if table.fs.exists(path):
            meta = table.fs.read_json(path)
            if meta["kind"] in kinds and meta["column"] == column and meta["version"] == s.version and metric in (None, meta.get("metric")):
                return _folder(table, name), meta
    return None


def _rows(table: Table, s: Snapshot, best: DataFrame, score: str, ascending: bool) -> DataFrame:
    """The table's rows at a few places, with their score, best first."""
    found = {(r["_file"], r["_at"]): r[score] for r in best.select("_file", "_at", score).collect()}
    files = sorted({f for f, _ in found})
    if not files:
        return table.frame(snapshot=s).limit(0).withColumn(score, F.lit(None).cast(best.schema[score].dataType))
    places = table.spark.createDataFrame([(f, i, v) for (f, i), v in found.items()], best.select("_file", "_at", score).schema)
    rows = table.spark.read.schema(s.schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    rows = rows.filter(F.col("_at").isin(sorted({i for _, i in found})))
    out = rows.join(F.broadcast(places), ["_file", "_at"]).drop("_file", "_at")
    by = F.col(score).asc() if ascending else F.col(score).desc()
    return out.orderBy(by, *search.ties(table.frame(snapshot=s)))


def _top(scored: DataFrame, table: Table, s: Snapshot, score: str, ascending: bool, k: int) -> DataFrame:
    """The places of the k best, ties by the rows' columns, which are read for rows that may be among them only."""
    by = F.col(score).asc() if ascending else F.col(score).desc()
    limit = scored.orderBy(by).limit(k).agg(F.max(score) if ascending else F.min(score)).first()[0]
    if limit is None:
        return scored.limit(0)
    may = scored.filter(F.col(score) <= limit if ascending else F.col(score) >= limit)
    rows = table._with_places(s)
    tie = rows.select("_file", "_at", F.struct(*search.ties(table.frame(snapshot=s)), "_file", "_at").alias("_tie"))
    return may.join(tie, ["_file", "_at"]).orderBy(by, "_tie").limit(k)


# Words


def _words(table: Table, rows: DataFrame, name: str, column: str) -> dict:
    split = rows.select("_file", "_at", F.explode(F.array(words(F.col(f"`{column}`")))).alias("w")).withColumn("length", F.size("w"))
    n, mean = split.agg(F.count("*"), F.avg("length")).first()
    each = split.select("_file", "_at", "length", F.explode("w").alias("term")).groupBy("term", "_file", "_at", "length").agg(F.count("*").alias("tf"))
    # By term, so that a search reads the few row groups that hold its words.
    each.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{_folder(table, name)}/words")
    return {"n": n, "mean": mean}


def text_search(table: Table, s: Snapshot, folder: str, meta: dict, query: str, k: int, score: str = "_score") -> DataFrame:
    """The k best rows by BM25, from the index."""
    terms = search.query_terms(query)
    if not terms:
        raise search.InvalidStatement("the query has no words")
    found = table.spark.read.parquet(f"{folder}/words").filter(F.col("term").isin(terms))
    df = {r.term: r["count"] for r in found.groupBy("term").count().collect()}
    norm = search.K1 * (1 - search.B + search.B * F.col("length") / F.lit(float(meta["mean"] or 1.0)))
    total = F.lit(0.0)
    wide = found.groupBy("_file", "_at", "length").agg(*(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(terms)))
    for i, t in enumerate(terms):  # in the order of the query, as a scan adds them
        total = total + F.lit(search.idf(meta["n"], df.get(t, 0))) * F.col(f"_tf{i}") * (search.K1 + 1) / (F.col(f"_tf{i}") + norm)
    return _rows(table, s, _top(wide.withColumn(score, total).select("_file", "_at", score), table, s, score, False, k), score, False)


# Vectors


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _cells(table: Table, rows: DataFrame, name: str, column: str, metric: str) -> dict | None:
    """Cells around centres that are learnt from a sample, each with its radius; vectors of the most frequent length take part, others are a cell of their own."""
    if metric not in ("l2", "cosine"):
        raise search.InvalidStatement(f"no vector index for the metric '{metric}'")
    vectors = rows.select("_file", "_at", F.col(f"`{column}`").cast("array<double>").alias("v")).filter("v is not null")
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return None
    d, n = sizes
    share = min(1 << 30, -(-(1 << 30) * SAMPLE // n))
    picked = vectors.filter((F.size("v") == d) & (F.pmod(F.xxhash64("_file", "_at"), F.lit(1 << 30)) < share)).select("v").toArrow()
    x = np.stack([np.nan_to_num(np.array(v, float)) for v in picked.column("v").to_pylist()]) if picked.num_rows else np.zeros((1, d))
    x = _unit(x) if metric == "cosine" else x
    cells = max(1, min(MOST_CELLS, math.isqrt(n)))
    rng = np.random.default_rng(len(x))
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = ((x @ centres.T) - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])

    @F.pandas_udf("cell int, away double")
    def place(column: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(column), -1, np.int32), np.zeros(len(column))
        good = np.flatnonzero([len(v) == d and np.isfinite(v).all() for v in column])
        if len(good):
            y = np.stack([np.asarray(v, float) for v in column.iloc[good]])
            y = _unit(y) if metric == "cosine" else y
            near = ((y @ centres.T) - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            cell[good], away[good] = near, np.sqrt(((y - centres[near]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "away": away})

    dealt = vectors.withColumn("p", place("v")).select("_file", "_at", "v", F.col("p.cell").alias("cell"), F.col("p.away").alias("away"))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{_folder(table, name)}/cells")
    radii = {r.cell: r.r for r in table.spark.read.parquet(f"{_folder(table, name)}/cells").groupBy("cell").agg(F.max("away").alias("r")).collect()}
    return {"metric": metric, "d": d, "centres": centres.tolist(), "radii": [radii.get(c, -1.0) for c in range(len(centres))], "others": -1 in radii}


def vector_search(table: Table, s: Snapshot, folder: str, meta: dict, query: list[float], k: int, metric: str, score: str = "_distance") -> DataFrame:
    """The k nearest rows: cells are read from the nearest on, and those whose nearest point is farther than the k-th row found aren't read."""
    cells = table.spark.read.parquet(f"{folder}/cells")
    centres, radii = np.array(meta["centres"]), np.array(meta["radii"])
    others = [-1] if meta["others"] else []
    if len(query) != meta["d"]:
        chosen = others
    else:
        q = np.array(query, float)
        q = _unit(q[None])[0] if metric == "cosine" else q
        away = np.sqrt(((centres - q) ** 2).sum(axis=1))
        order = np.argsort(np.where(radii < 0, np.inf, away), kind="stable")
        first = order[: max(1, math.isqrt(len(order)))].tolist()
        near = _scored(cells.filter(F.col("cell").isin(first)), query, metric, score).orderBy(score).limit(k).agg(F.count("*"), F.max(score)).first()
        reach = np.inf if near[0] < k else float(near[1]) if metric == "l2" else 2 * float(near[1])
        # Both metrics grow with the distance between (scaled) vectors; a little more, as scores are in single precision.
        least = np.maximum(0, away - radii - 1e-9) ** 2
        chosen = [*others, *(c for c in order.tolist() if radii[c] >= 0 and least[c] <= reach * (1 + 1e-5) + 1e-6)]
    scored = _scored(cells.filter(F.col("cell").isin(chosen)), query, metric, score)
    return _rows(table, s, _top(scored, table, s, score, True, k), score, True)


def _scored(cells: DataFrame, query: list[float], metric: str, score: str) -> DataFrame:
    return cells.select("_file", "_at", distance(F.col("v"), query, metric).cast("float").alias(score)).filter(F.col(score).isNotNull())
