"""Keyword retrieval: terms, inverse frequencies, BM25 ranks and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomwork.functions.shared import written
from loomwork.functions.text import words
from loomwork.operators.best import UNIT, best

K1, B = 1.5, 0.75
#: Postings, or terms of queries, that one task holds at most.
BLOCK = 1_000_000


def terms(documents: DataFrame, key: str, text: str, pattern: str = "[a-z0-9]{2,}") -> DataFrame:
    """``key, term, tf, length``: counts of each term and the document's number of words."""
    w = documents.select(key, words(F.col(text), pattern).alias("w")).filter(F.size("w") > 0)
    return w.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def inverse_frequencies(postings: DataFrame, key: str) -> DataFrame:
    """``term, df, idf`` over all documents with words."""
    n = postings.agg(F.count_distinct(key).alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(postings: DataFrame, queries: DataFrame, key: str, query_key: str, top: int = 5) -> DataFrame:
    """The best documents of each query ``query_key, term``: ``query_key, key, score, rank``; scores equal to nine places are ties and go to the lesser key.

    Only the queries' terms are taken from the postings. Blocks of documents meet blocks of queries, and each gives a query's
    best of its documents alone, so no row is made for a query and a document that share a term.
    """
    p = written(postings, "postings")
    lengths = p.select(key, "length").distinct().agg(F.avg("length").alias("mean"))
    asked = queries.select(query_key, "term").filter(F.col("term").isNotNull()).distinct()
    weights = written(inverse_frequencies(p, key).join(asked.select("term").distinct(), "term", "left_semi"), "weights")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    held = p.join(weights, "term").join(F.broadcast(lengths)).select("term", part.alias("part"), F.col(key).alias("key"))
    blocks = max(p.sparkSession.sparkContext.defaultParallelism, -(-(weights.agg(F.sum("df")).first()[0] or 0) // BLOCK))
    parts = max(1, -(-asked.count() // BLOCK))
    # every block of documents beside every part of the queries
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = held.select("*", at("key", blocks).alias("block"), each(parts).alias("of"))
    right = asked.select("term", F.col(query_key).alias("query")).select("*", at("query", parts).alias("of"), each(blocks).alias("block"))
    cells = left.unionByName(right, allowMissingColumns=True).repartitionById(blocks * parts, F.col("block") * parts + F.col("of")).select("term", "part", "key", "query")
    schema = StructType([StructField("query", queries.schema[query_key].dataType), StructField("key", postings.schema[key].dataType), StructField("score", DoubleType())])
    scored = cells.mapInArrow(lambda batches: best(batches, top), schema)
    order = Window.partitionBy("query").orderBy(F.desc(F.floor(F.col("score") * UNIT + 0.5)), F.asc_nulls_last("key"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank")


def recall(ranked: DataFrame, truth: DataFrame, query_key: str, key: str, at: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of the queries of ``truth`` whose document is among the first."""
    joined = truth.join(ranked.select(query_key, key, "rank"), [query_key, key], "left")
    return joined.agg(*((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in at))


def novelty(documents: DataFrame, key: str, order: list[str], text: str, within: str | None = None) -> DataFrame:
    """Share of each document's words that no earlier one of the group has: ``key, words, novelty``; null groups are one group."""
    w = documents.select(key, *order, *([within] if within else []), F.array_distinct(words(F.col(text), "[a-z0-9]{3,}")).alias("w")).filter(F.size("w") > 0)
    each = w.select(key, *order, *([within] if within else []), F.explode("w").alias("token"))
    group = [within, "token"] if within else ["token"]
    first = each.groupBy(*group).agg(F.min(F.struct(*order, key)).alias("first"))
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    mark = each.alias("l").join(first.alias("r"), same).select("l.*", "r.first").withColumn("fresh", (F.col("first") == F.struct(*order, key)).cast("int"))
    return mark.groupBy(key).agg(F.count("*").alias("words"), F.avg("fresh").alias("novelty"))
