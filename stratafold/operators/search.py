"""Vector, full-text and hybrid search as plans: a score column, and Spark's own distributed top k."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidStatement
from ..functions.text import words
from ..functions.vectors import distance

#: Fixed values of the BM25 and reciprocal-rank formulas.
K1, B, RANK_CONSTANT = 1.2, 0.75, 60
#: Rows of either ranking from which a hybrid search takes its candidates: this many times k, and this many at least.
POOL, LEAST_POOL = 4, 100


def vector_search(df: DataFrame, column: str, query: list[float], k: int = 10, metric: str = "l2", score: str = "_distance", squared: bool = True) -> DataFrame:
    """The k rows nearest to the query, with their distance. Rows without a vector of its length take no part."""
    value = distance(F.col(column), query, metric)
    if metric == "l2" and not squared:
        value = F.sqrt(value)
    scored = df.withColumn(score, value.cast("float")).filter(F.col(score).isNotNull())
    return scored.orderBy(F.col(score), *ties(df)).limit(k)


def ties(df: DataFrame) -> list[Column]:
    """What orders rows of equal score: their plain columns, from the first on."""
    return [F.col(f"`{n}`") for n, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]


def query_terms(query: str) -> list[str]:
    """The distinct words of a query; the word OR between them is left out, as any word may match."""
    return list(dict.fromkeys(w.lower() for w in re.split(r"[^\w]+", query.replace("_", " ")) if w and w != "OR"))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(df: DataFrame, columns: list[str], query: str, score: str = "_score") -> DataFrame:
    """Rows that hold some word of the query, with their BM25 score; higher is better.

    Word counts of each row are taken in the scan; one aggregation gives the number of rows, the mean length and each word's rows.
    """
    terms = query_terms(query)
    if not terms:
        raise InvalidStatement("the query has no words")
    text = F.concat_ws(" ", *(F.col(c) for c in columns))

    def counted(frame: DataFrame) -> DataFrame:
        # Through explode() of one element the words are split once; as a plain column they would be, for each use of them.
        frame = frame.withColumn("_words", F.explode(F.array(words(text))))
        return frame.withColumns({f"_tf{i}": F.size(F.filter("_words", _equals(t))) for i, t in enumerate(terms)} | {"_length": F.size("_words")})

    rows = counted(df)
    stats = rows.select("_length", *(f"_tf{i}" for i in range(len(terms)))).agg(F.count("*").alias("n"), F.avg("_length").alias("mean"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms)))).first()
    norm = K1 * (1 - B + B * F.col("_length") / F.lit(float(stats["mean"] or 1.0)))
    total: Column = F.lit(0.0)
    for i in range(len(terms)):
        total = total + F.lit(idf(stats["n"], stats[f"d{i}"])) * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + norm)
    match, low, holds = F.lit(False), F.lower(text), F.lit(False)
    for i, t in enumerate(terms):
        match = match | (F.col(f"_tf{i}") > 0)
        holds = holds | F.contains(low, F.lit(t))  # a text without the letters of some word has none of the words
    return counted(df.filter(holds)).filter(match).withColumn(score, total).drop("_words", "_length", *(f"_tf{i}" for i in range(len(terms))))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def text_search(df: DataFrame, column: str, query: str, k: int = 10, score: str = "_score") -> DataFrame:
    """The k best rows by BM25."""
    return bm25(df, [column], query, score=score).orderBy(F.col(score).desc(), *ties(df)).limit(k)


def identified(df: DataFrame, name: str) -> DataFrame:
    """The rows with an identity that is the same in every plan that reads them: their place in a scanned file, or else one that is written down."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("SubqueryAlias", "View"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(name))
    return df.withColumn(name, F.monotonically_increasing_id()).checkpoint()


def hybrid_search(df: DataFrame, vector_column: str, vector: list[float], text_column: str, query: str, k: int = 10, metric: str = "l2", score: str = "_hybrid_score") -> DataFrame:
    """The k best rows by the sum of reciprocal ranks in a vector search and a text search, each over all of its rows; ties by the rows' columns.

    A row beyond the first `pool` of both rankings has less than 2 / (RANK_CONSTANT + pool), which the first k rows of either
    ranking exceed; so only rows within are candidates, and those are ranked exactly by counting the rows before them.
    """
    pool = max(LEAST_POOL, POOL * k, RANK_CONSTANT + 2 * k)
    rows = identified(df, "_row")
    order = F.struct(*ties(df), "_row").alias("_tie")
    near = rows.select("_row", order, distance(F.col(vector_column), vector, metric).cast("float").alias("_by")).filter(F.col("_by").isNotNull())
    best = bm25(rows, [text_column], query, score="_score").select("_row", order, (-F.col("_score")).alias("_by"))
    first = [x.orderBy("_by", "_tie").limit(pool).select("_row", "_tie") for x in (near, best)]
    candidates = F.broadcast(first[0].union(first[1]).distinct())

    def parts(ranking: DataFrame) -> DataFrame:
        own = F.broadcast(ranking.join(candidates.select("_row"), "_row").select(F.col("_row").alias("_own"), F.col("_tie").alias("_of"), F.col("_by").alias("_at")))
        upto = (F.col("_by") < F.col("_at")) | ((F.col("_by") == F.col("_at")) & (F.col("_tie") <= F.col("_of")))
        return ranking.join(own, upto).groupBy("_own", "_of").agg((1 / (RANK_CONSTANT + F.count("*"))).alias("_part"))

    both = parts(near).unionAll(parts(best)).groupBy("_own", "_of").agg(F.sum("_part").alias(score)).orderBy(F.col(score).desc(), "_of").limit(k)
    return rows.join(F.broadcast(both), F.col("_row") == F.col("_own")).orderBy(F.col(score).desc(), "_of").select(*(F.col(f"`{c}`") for c in df.columns), score)
