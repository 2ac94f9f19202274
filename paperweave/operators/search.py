"""Ranked keyword search over zones, author search and cited-by look-up.

A query is a list of tokens with repeats: a term that occurs m times has the weight m * idf, adds m times to the
query's length and m times to every score.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.functions.text import SPACE, raw_tokens
from paperweave.operators.index import Index

#: Coefficients of the zones. The full-text ones are those in effect; the declared ones can be asked for.
TITLE_AND_ABSTRACT = {"title": 0.6, "abstract": 0.4}
FULL_TEXT = {"title": 0.40, "abstract": 0.60, "body": 0.25}
FULL_TEXT_DECLARED = {"title": 0.40, "abstract": 0.35, "body": 0.25}


def typed_terms(texts: dict[str, str]) -> list[str]:
    """The distinct tokens of typed queries."""
    return sorted({t for q in texts.values() for t in re.split(SPACE, q.lower())})


def make_queries(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(query_id, term, m): tokens as typed, lower-cased and split at white space, with their number."""
    rows = spark.createDataFrame(sorted(texts.items()), "query_id string, query string")
    tokens = rows.select("query_id", F.explode(raw_tokens(F.col("query"))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count("*").alias("m"))


def score_zones(index: Index, queries: DataFrame, zones: dict[str, float], small_queries: bool = True) -> DataFrame:
    """(query_id, peer, urn, score): coefficients times cosines, summed over the zones.

    ``small_queries``: queries typed by people are few and are sent to every task; else they are joined by term. A paper that holds any term
    of the query is returned even if it scores 0.
    """
    asked = F.broadcast(queries) if small_queries else queries
    idf = index.idf.where(F.col("zone").isin(*zones)).join(asked, "term").withColumn("wq", F.col("m") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("m") * F.col("wq") * F.col("wq")).over(Window.partitionBy("query_id", "peer", "zone")))
    terms = idf.withColumn("length", length).select("query_id", "peer", "zone", "term", "m", F.when(F.col("length") > 0, F.col("wq") / F.col("length")).otherwise(0.0).alias("q"))
    coefficient = F.create_map(*(x for z, c in zones.items() for x in (F.lit(z), F.lit(c))))[F.col("zone")]
    matched = index.postings.where(F.col("zone").isin(*zones)).join(terms, ["peer", "zone", "term"])
    return matched.groupBy("query_id", "peer", "urn").agg(F.sum(coefficient * F.col("m") * F.col("weight") * F.col("q")).alias("score"), F.count_distinct("term").alias("terms_found"))


def top_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each group with their rank; scores are compared to nine places and ties broken by urn."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "urn")
    return scores.withColumn("result_rank", F.row_number().over(order)).where(F.col("result_rank") <= k)


def enrich(results: DataFrame, papers: DataFrame, pagerank: DataFrame | None = None, citing: DataFrame | None = None) -> DataFrame:
    """Title, rank in the citation graph (-1 if there is none) and number of citing papers of every result."""
    out = results.join(papers.select("peer", "urn", "title"), ["peer", "urn"], "left")
    if pagerank is not None:
        out = out.join(pagerank.select("peer", "urn", "rank"), ["peer", "urn"], "left").withColumn("pagerank", F.coalesce("rank", F.lit(-1.0))).drop("rank")
    if citing is not None:
        out = out.join(citing.select("peer", "urn", "cited_by"), ["peer", "urn"], "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))
    return out


def search(index: Index, queries: DataFrame, zones: dict[str, float], k: int = 10, mode: str = "or") -> DataFrame:
    """The k best papers of every peer for every query. ``mode`` "and" keeps papers that hold all of the query's terms in one of the zones or another."""
    scores = score_zones(index, queries, zones)
    if mode == "and":
        needed = queries.groupBy("query_id").agg(F.count("*").alias("needed"))
        scores = scores.join(F.broadcast(needed), "query_id").where("terms_found = needed").drop("needed")
    return top_k(scores.drop("terms_found"), k, "query_id", "peer")


def search_authors(authors: DataFrame, papers: DataFrame, query: str) -> DataFrame:
    """Papers one of whose authors has the first token of the query as a token of the name; each once, unranked."""
    first = query.lower().split()[0] if query.split() else ""
    found = authors.where(F.array_contains(raw_tokens(F.col("author_name")), first)).select("peer", "urn").distinct()
    return papers.select("peer", "urn", "title").join(found, ["peer", "urn"], "left_semi")


def citing_papers(citations: DataFrame, urn: str) -> DataFrame:
    """Papers that cite the given one; none for an unknown urn."""
    return citations.where(F.col("cited_urn") == urn).select("peer", F.col("citing_urn").alias("urn")).distinct()


def citation_counts(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """(peer, urn, cited_by) of every paper: distinct citing papers, 0 if none."""
    counts = citations.groupBy("peer", F.col("cited_urn").alias("urn")).agg(F.count_distinct("citing_urn").alias("cited_by"))
    return papers.select("peer", "urn").join(counts, ["peer", "urn"], "left").select("peer", "urn", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))
